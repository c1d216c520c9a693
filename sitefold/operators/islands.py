"""Chains of neighbouring positions (gaps and islands) without a task for a whole chromosome.

Positions are windowed within bins; one row for each occupied bin then tells which chain runs
into the next bin, and the chains' starts are handed back to the bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.schema import CORE, five_prime, packed, require, strand_rank

#: Positions in a bin.
BIN = 1 << 14


def bin_of(pos: Column) -> Column:
    return F.floor(pos / BIN).cast("bigint")


def binned(points: DataFrame, keys: list[str], pos: str, gap: int, tasks: int | None = None, start: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The points with their bin and the chain's start within it, and one row a bin with what runs into it.

    A chain also starts where the column ``start`` is true, if given.  A chain is long if a bin of it has no chain's start;
    ``_long`` holds the (at most two) long chains of a bin.  Bins are windowed in ``tasks`` partitions, if given; points that
    have their ``_bin`` already are taken as they are dealt.
    """
    df = points if "_bin" in points.columns else points.withColumn("_bin", bin_of(F.col(pos)))
    if tasks:
        df = df.repartition(tasks, *keys, "_bin")
    order = Window.partitionBy(*keys, "_bin").orderBy(pos)
    apart = F.col(pos) - F.lag(pos).over(order) > gap
    df = df.withColumn("_cut", F.when(apart | F.col(start) if start else apart, F.col(pos)))
    df = df.withColumn("_own", F.last("_cut", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = df.groupBy(*keys, "_bin").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.max("_cut").alias("cut"))
    run = Window.partitionBy(*keys).orderBy("_bin")
    fresh = F.coalesce(F.col("lo") - F.lag("hi").over(run) > gap, F.lit(True))
    ends = ends.withColumn("new", F.when(fresh, F.col("lo"))).withColumn("event", F.coalesce("cut", "new"))
    carried = F.last("event", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_head", F.coalesce("new", carried)).withColumn("_out", F.coalesce("event", "_head"))
    whole = F.max(F.col("event").isNull()).over(Window.partitionBy(*keys, "_out"))
    ends = ends.withColumn("_after", F.when(whole, F.col("_out")))
    heads = ends.select(*keys, "_bin", "_head", F.array_compact(F.array(F.lag("_after").over(run), "_after")).alias("_long"))
    return df, heads


def chains(points: DataFrame, keys: list[str], pos: str, gap: int, name: str = "island", tasks: int | None = None, start: str | None = None) -> DataFrame:
    """Adds the first position of each row's chain; consecutive positions of a chain are at most ``gap`` apart.  ``tasks`` and ``start`` as in ``binned``."""
    df, heads = binned(points, keys, pos, gap, tasks, start)
    out = df.join(heads.drop("_long"), [*keys, "_bin"]).withColumn(name, F.coalesce("_own", "_head"))
    return out.select(*points.columns, name)


def chain_numbers(found: DataFrame, keys: list[str], order: list[Column], name: str = "island") -> DataFrame:
    """keys, ``name`` and ``number``: the chains counted from 1 in the order of the keys and positions."""
    starts = found.select(*keys, name).distinct().withColumn("_bin", bin_of(F.col(name)))
    sizes = starts.groupBy(*keys, "_bin").agg(F.count("*").alias("n"))
    # one row for each occupied bin
    run = Window.orderBy(*order, "_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "_bin", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(name))
    return starts.withColumn("_place", place).join(before, [*keys, "_bin"]).select(*keys, name, (F.col("before") + F.col("_place")).cast("bigint").alias("number"))


def serial_cluster(sites: DataFrame, gaps: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """For each gap a column ``clusID_<gap>nt`` with the number of the row's chain of 5' positions (null without a sequence, strand or position)."""
    require(sites, *CORE)
    keys = ["seqnames", "strand"]
    out = packed(sites, seqnames=F.col("seqnames"), strand=F.col("strand"), pos=five_prime())
    points = out.select(*keys, "pos").distinct()
    for gap in gaps:
        found = chains(points, keys, "pos", gap)
        numbers = chain_numbers(found, keys, [F.col("seqnames"), strand_rank(F.col("strand"))])
        named = found.join(numbers, [*keys, "island"]).select(*keys, "pos", F.col("number").alias(f"clusID_{gap}nt"))
        out = out.join(named, [*keys, "pos"], "left")
    return out.select("row.*", *[f"clusID_{g}nt" for g in gaps])


def graph_clusters(sites: DataFrame, gap: int, row_id: str = "row_id") -> DataFrame:
    """Star edges (src, dst) of each chain, from its first row to every row, itself included."""
    require(sites, *CORE, row_id)
    keys = ["seqnames", "strand"]
    rows = sites.select(*keys, five_prime().alias("pos"), F.col(row_id).alias("id"))
    points = rows.select(*keys, "pos").distinct()
    named = rows.join(chains(points, keys, "pos", gap), [*keys, "pos"])
    first = named.groupBy(*keys, "island").agg(F.min_by("id", F.struct("pos", "id")).alias("src"))
    return named.join(first, [*keys, "island"]).select("src", F.col("id").alias("dst")).distinct()
