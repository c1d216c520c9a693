"""Older ways to snap positions: to the heaviest value within a window, or to a chain's mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.operators.islands import BIN, chains
from sitefold.schema import CORE, five_prime, packed, require, stranded, tasks_for, three_prime

KEYS = ["grouping", "posID"]


def value_counts(df: DataFrame, pos_id: str, value: str, grouping: str | None, weight: str | None, top: str | None = None) -> DataFrame:
    """grouping, posID, value and the summed weights (rows without a weight count 1); ``top`` adds the greatest value of that column."""
    rows = df.select(
        (F.col(grouping).cast("string") if grouping else F.lit("")).alias("grouping"),
        F.col(pos_id).cast("string").alias("posID"),
        F.col(value).cast("bigint").alias("value"),
        (F.col(weight) if weight else F.lit(1)).alias("w"),
        *([F.col(top).alias("top")] if top else []),
    )
    return rows.groupBy(*KEYS, "value").agg(F.sum("w").alias("freq"), *([F.max("top").alias("top")] if top else []))


def _haloed(counts: DataFrame, halo: int, tasks: int) -> DataFrame:
    """The values by bins in ``tasks`` partitions, with copies (``_own`` false) in the bins they lie within ``halo`` of: windows of a bin see all of its neighbours."""
    size = max(BIN, 4 * halo)
    bin_ = lambda v: F.floor(v / size).cast("bigint")
    ends = F.array_distinct(F.array(bin_(F.col("value") - halo), bin_(F.col("value")), bin_(F.col("value") + halo)))
    return counts.withColumn("_b", F.explode(ends)).withColumn("_own", F.col("_b") == bin_(F.col("value"))).repartition(tasks, *KEYS, "_b")


def _within(low: int, high: int) -> Window:
    return Window.partitionBy(*KEYS, "_b").orderBy("value").rangeBetween(low, high)


def _snapped(counts: DataFrame, window: int, tasks: int) -> DataFrame:
    """One step: a value moves to the heaviest one within the window, itself included, and to the least of equals."""
    best = F.max(F.struct("freq", (-F.col("value")).alias("v"))).over(_within(-window, window))
    return _haloed(counts, window, tasks).withColumn("clusteredValue", -best["v"]).filter("_own").drop("_b", "_own")


def _by_quantile(counts: DataFrame, window: int, quantile: float, tasks: int) -> DataFrame:
    """Values under their posID's quantile of weights join the heaviest (then closest, then last) value above it; the others under it are snapped among themselves."""
    limits = counts.groupBy(*KEYS).agg(F.percentile("freq", F.lit(quantile)).alias("limit"))
    # what the second step sees are values whose own neighbours the first one saw: two windows of halo
    named = _haloed(counts.join(limits, KEYS), 2 * window, tasks).withColumn("_above", F.col("freq") >= F.col("limit"))
    above = lambda v: F.max(F.when(F.col("_above"), F.struct("freq", v.alias("v"))))
    named = named.withColumn("_l", above(F.col("value")).over(_within(-window, -1))).withColumn("_r", above(-F.col("value")).over(_within(1, window)))
    left, right = F.col("_l.v"), -F.col("_r.v")
    to_left = F.when(F.col("_l.freq") != F.col("_r.freq"), F.col("_l.freq") > F.col("_r.freq")).otherwise(F.col("value") - left < right - F.col("value"))
    taken = F.when(left.isNull() | right.isNull(), F.coalesce(left, right)).otherwise(F.when(to_left, left).otherwise(right))
    named = named.withColumn("_taken", F.when(F.col("_above"), F.col("value")).otherwise(taken))
    lone = F.max(F.when(F.col("_taken").isNull(), F.struct("freq", (-F.col("value")).alias("v")))).over(_within(-window, window))
    named = named.withColumn("_lone", -lone["v"]).filter("_own")
    return named.withColumn("clusteredValue", F.coalesce("_taken", "_lone")).select(*counts.columns, "clusteredValue")


def cluster_values(
    df: DataFrame,
    pos_id: str,
    value: str,
    grouping: str | None = None,
    weight: str | None = None,
    window: int = 5,
    by_quartile: bool = False,
    quartile: float = 0.70,
    top: str | None = None,
) -> DataFrame:
    """posID, value, freq, clusteredValue and its freq (and grouping, if given) of every distinct value; ``top`` adds ``best``, that column's greatest value in the cluster."""
    require(df, pos_id, value, *[c for c in (grouping, weight, top) if c])
    counts = value_counts(df, pos_id, value, grouping, weight, top)
    # rows without a group, a position's id or a value belong to no cluster
    counts = counts.filter(F.col("grouping").isNotNull() & F.col("posID").isNotNull() & F.col("value").isNotNull())
    tasks = tasks_for(df)
    found = _by_quantile(counts, window, quartile, tasks) if by_quartile else _snapped(counts, window, tasks)
    # a cluster has at most the values within the window of its own
    cluster = Window.partitionBy(*KEYS, "clusteredValue")
    out = found.repartition(tasks, *KEYS, "clusteredValue").withColumn("clusteredValue.freq", F.sum("freq").over(cluster))
    if top:
        out = out.withColumn("best", F.max("top").over(cluster))
    return out.select(*(["grouping"] if grouping else []), "posID", "value", "freq", "clusteredValue", F.col("`clusteredValue.freq`"), *(["best"] if top else []))


def cluster_sites(
    sites: DataFrame, position: str = "Position", weight: str | None = None, grouping: str | None = None, score: str | None = None, window: int = 5, multihit: str = "isMultiHit"
) -> DataFrame:
    """The rows with clusteredPosition, clonecount and clusterTopHit (the best score of its position); multi-hits stay as they are.

    Without a weight, "counts=N" in a column qName gives it.
    """
    require(sites, "seqnames", "strand", position)
    if weight is None and "qName" in sites.columns:
        by = F.coalesce(F.regexp_extract("qName", r"counts=(\d+)", 1).try_cast("bigint"), F.lit(1))
    else:
        by = F.col(weight) if weight else F.lit(1)
    named = packed(
        sites,
        g=F.col(grouping).cast("string") if grouping else F.lit(""),
        p=F.concat("seqnames", F.lit("|"), "strand"),
        v=F.col(position).cast("bigint"),
        w=by,
        top=F.col(score) if score else F.lit(1),
        multi=F.coalesce(F.col(multihit), F.lit(False)) if multihit in sites.columns else F.lit(False),
    )
    found = cluster_values(named.filter("not multi"), "p", "v", "g", "w", window, top="top").select(
        F.col("grouping").alias("fg"), F.col("posID").alias("fp"), F.col("value").alias("fv"), F.col("clusteredValue").alias("clusteredPosition"), F.col("`clusteredValue.freq`").alias("clonecount"), "best"
    )
    out = named.join(found, ~F.col("multi") & _same_value(), "left")
    return out.select("row.*", "clusteredPosition", "clonecount", F.coalesce(F.col("top") == F.col("best"), F.lit(False)).alias("clusterTopHit"))


def _same_value() -> Column:
    return F.col("g").eqNullSafe(F.col("fg")) & (F.col("p") == F.col("fp")) & (F.col("v") == F.col("fv"))


def standardize_by_window(sites: DataFrame, window: int = 5) -> DataFrame:
    """The rows with their 5' position snapped to the heaviest position within the window."""
    require(sites, *CORE)
    named = sites.withColumns({"_Position": F.when(stranded() == "+", F.col("start")).otherwise(F.col("end"))})
    found = cluster_sites(named, "_Position", window=window)
    plus = F.col("strand") == "+"
    moved = {"start": F.when(plus, F.col("clusteredPosition")).otherwise(F.col("start")), "end": F.when(plus, F.col("end")).otherwise(F.col("clusteredPosition"))}
    return found.withColumns(moved).select(*sites.columns)


def normalize_intsite_positions(sites: DataFrame, gap: int = 0) -> DataFrame:
    """The rows with called_pos, called_bp, pos_clus (the chain's first position) and norm_pos, the chain's most frequent position; of equals the upstream one."""
    require(sites, *CORE)
    rows = sites.withColumns({"called_pos": five_prime(), "called_bp": three_prime()})
    points = rows.groupBy("seqnames", "strand", F.col("called_pos").alias("_pos")).agg(F.count("*").alias("_n"))
    found = chains(points, ["seqnames", "strand"], "_pos", gap, "pos_clus")
    up = F.when(F.col("strand") == "-", F.col("_pos")).otherwise(-F.col("_pos"))
    best = found.groupBy("seqnames", "strand", "pos_clus").agg(F.max(F.struct("_n", up.alias("up"), F.col("_pos").alias("p"))).alias("top"))
    key = found.join(best, ["seqnames", "strand", "pos_clus"]).select("seqnames", "strand", F.col("_pos").alias("called_pos"), "pos_clus", F.col("top.p").alias("norm_pos"))
    out = rows.join(key, ["seqnames", "strand", "called_pos"])
    minus = F.col("strand") == "-"
    moved = {"start": F.when(minus, F.col("called_bp")).otherwise(F.col("norm_pos")), "end": F.when(minus, F.col("norm_pos")).otherwise(F.col("called_bp"))}
    return out.withColumns(moved).select(*sites.columns, "called_pos", "called_bp", "pos_clus", "norm_pos")
