"""Consensus positions of noisy sites (5') and break points (3').

Observed points are linked to a neighbour point by point: the heavier one draws the lighter one.  The state
is one link per point to its next point, FORWARD (from the lower position to the higher), BACK or
none, so each phase is a window over the points of a chromosome's strand.  No link spans more
than the widest gap, so points are first cut into chains of that gap, and all windows are
partitioned by chain: they share one shuffle and no task holds a chromosome.  Where points lie within the gap
over whole bins, a chain is cut again wherever no phase looks across (``safe_starts``).

For ``min_gap`` above 1 links join consecutive points only, and satellites start at ``min_gap`` + 1; below
2, ``sata_gap`` has no satellite pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.checkpoints import durable
from sitefold.operators.islands import bin_of, binned, chains
from sitefold.schema import CORE, five_prime, packed, require, stranded, tasks_for, three_prime

FORWARD, BACK, NONE = 1, -1, 0
#: The chain comes first, as it tells most rows apart when windows are sorted.
KEYS = ["chain", "seqnames", "strand"]

#: Positions of its neighbours that a bin of a long chain sees on each side.
HALO = 1 << 11


def _order(df: DataFrame) -> Window:
    """Points of a chain by position.  Islands are numbered along it: once there, they go first, so that one sort also serves the windows of islands."""
    return Window.partitionBy(*KEYS).orderBy(*(["island"] if "island" in df.columns else []), "pos")


def _whole(name: str) -> Window:
    """All points of an island or group, sorted as ``_order`` sorts them."""
    return Window.partitionBy(*KEYS, name).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _previous(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.lag(name).over(_order(df)), F.lit(NONE))


def points(sites: DataFrame, pos: Column, counts_col: str | None, gap: int, min_gap: int = 1, sata_gap: int | None = None, bias: str = "upstream") -> DataFrame:
    """Distinct points with their summed counts and their chain, for phases with these gaps (``sata_gap``: ``gap`` if not given) and bias."""
    require(sites, *CORE, *([counts_col] if counts_col else []))
    count = F.coalesce(F.col(counts_col), F.lit(0)) if counts_col else F.lit(1)
    found = sites.select("seqnames", stranded().alias("strand"), pos.cast("bigint").alias("pos"), count.alias("c"))
    # rows without a sequence or position make no point
    found = found.filter(F.col("seqnames").isNotNull() & F.col("pos").isNotNull())
    # every phase sorts what its task holds, so there are as many tasks as the rows ask for, not as few as a small shuffle is merged into or as
    # the session has; rows are dealt by bin before they are summed, which serves the sums and the windows of bins
    tasks = tasks_for(found)
    on, columns = ["seqnames", "strand"], ["seqnames", "strand", "pos", "abund"]
    found = found.withColumn("_bin", bin_of(F.col("pos"))).repartition(tasks, "_bin", *on)
    found = found.groupBy("_bin", *on, "pos").agg(F.sum("c").alias("abund"))
    df, heads = binned(found, on, "pos", gap)
    # one row a bin, kept: it tells whether there are long chains
    heads = durable(heads)
    df = df.join(heads, [*on, "_bin"]).withColumn("chain", F.coalesce("_own", "_head"))
    cut = df.select(*columns, "chain")
    if not heads.filter(F.size("_long") > 0).isEmpty():
        long = F.array_contains("_long", F.col("chain"))
        starts = durable(safe_starts(df.filter(long).select(*columns), tasks, min_gap, gap if sata_gap is None else sata_gap, bias))
        parts = chains(starts, on, "pos", gap, "chain", tasks, "fresh").drop("fresh")
        cut = df.filter(~long).select(*columns, "chain").unionByName(parts)
    return cut.repartition(tasks, *KEYS)


def _known(df: DataFrame) -> DataFrame:
    """Narrows the links that hold whatever lies outside of the rows, _lo to _hi, to those beyond the first and last known point without a link."""
    rows, bare = Window.partitionBy(*KEYS), F.col("link") == NONE
    first, last = F.when(bare & (F.col("pos") >= F.col("_lo")), F.col("pos")), F.when(bare & (F.col("pos") <= F.col("_hi")), F.col("pos"))
    return df.withColumns({"_lo": F.min(first).over(rows) + 1, "_hi": F.max(last).over(rows) - 1})


def safe_starts(df: DataFrame, tasks: int, min_gap: int, sata_gap: int, bias: str) -> DataFrame:
    """``fresh``: whether the phases come out the same if the point and those before it are taken apart.

    That is so if no pass links them and their islands' sources are too far apart to be joined.  It is worked out by bins with a halo;
    a link of the first passes holds for certain, one of a later pass only between islands that are known from end to end.
    """
    tiles = F.explode(F.sequence(bin_of(F.col("pos") - HALO), bin_of(F.col("pos") + HALO)))
    df = df.withColumn("chain", tiles).repartition(tasks, *KEYS)
    rows = Window.partitionBy(*KEYS)
    df = initial_links(df.withColumns({"_lo": F.min("pos").over(rows), "_hi": F.max("pos").over(rows) - 1}), min_gap, bias)
    for gap in _satellite_gaps(min_gap, sata_gap):
        df = connect_satellites(_known(df), gap)
    # what is right of a known point without a link does not depend on what is left of it, cuts included
    df = _known(df)
    df = df.withColumn("_apart", _previous(df, "link") == NONE)
    df = mark_sources_and_sinks(with_islands(break_paths(df, bias)))
    df = df.withColumn("_source", F.max(F.when(F.col("is_source"), F.col("pos"))).over(_whole("island")))
    order = _order(df)
    known = (F.lag("pos").over(order) >= F.col("_lo")) & (F.col("pos") <= F.col("_hi") + 1)
    fresh = known & F.col("_apart") & (F.col("_source") - F.lag("_source").over(order) > sata_gap)
    df = df.withColumn("fresh", F.coalesce(fresh, F.lit(False)))
    return df.filter(F.col("chain") == bin_of(F.col("pos"))).select("seqnames", "strand", "pos", "abund", "fresh")


def _satellite_gaps(min_gap: int, sata_gap: int) -> range:
    return range(max(2, min_gap + 1), sata_gap + 1)


def initial_links(df: DataFrame, min_gap: int, bias: str) -> DataFrame:
    """Links of consecutive points at most ``min_gap`` apart: from the heavier one; if equal from the upstream one, or downstream one."""
    order = _order(df)
    near = F.lead("pos").over(order) - F.col("pos") <= min_gap
    other = F.lead("abund").over(order)
    up = F.when(F.col("strand") == "-", BACK).otherwise(FORWARD)
    tie = up if bias == "upstream" else -up
    return df.withColumn("link", F.when(near, F.when(F.col("abund") > other, FORWARD).when(F.col("abund") < other, BACK).otherwise(tie)).otherwise(NONE))


def with_islands(df: DataFrame, name: str = "island") -> DataFrame:
    """Numbers the runs of linked points within a chain."""
    upto = _order(df).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_new", (_previous(df, "link") == NONE).cast("int")).withColumn(name, F.sum("_new").over(upto)).drop("_new")


def connect_satellites(df: DataFrame, gap: int) -> DataFrame:
    """Links neighbouring islands at most ``gap`` apart from the one with the larger sum, if its least abundance is not the smaller one.

    ``island`` stays, as it was before the links, for the order of the next phase.
    """
    own = _whole("island")
    df = with_islands(df).withColumns({"_min": F.min("abund").over(own).cast("bigint"), "_sum": F.sum("abund").over(own)})
    order = _order(df)
    df = df.withColumns({"_gap": F.lead("pos").over(order) - F.col("pos"), "_nmin": F.lead("_min").over(order), "_nsum": F.lead("_sum").over(order)})
    link = (
        F.when((F.col("_min") >= F.col("_nmin")) & (F.col("_sum") > F.col("_nsum")), FORWARD)
        .when((F.col("_nmin") >= F.col("_min")) & (F.col("_nsum") > F.col("_sum")), BACK)
        .otherwise(NONE)
    )
    open_ = (F.col("link") == NONE) & (F.col("_gap") <= gap)
    return df.withColumn("link", F.when(open_, link).otherwise(F.col("link"))).drop("_min", "_sum", "_gap", "_nmin", "_nsum")


def break_paths(df: DataFrame, bias: str) -> DataFrame:
    """Cuts one link at each point that is drawn from both sides: the longer one, then the one to the lighter neighbour, then by bias."""
    order = _order(df)
    left, right = F.col("pos") - F.lag("pos").over(order), F.lead("pos").over(order) - F.col("pos")
    light, heavy = F.lag("abund").over(order), F.lead("abund").over(order)
    upstream_left = F.col("strand") != "-"
    tie_left = upstream_left if bias == "upstream" else ~upstream_left
    cut_left = F.when(left != right, left > right).when(light != heavy, light < heavy).otherwise(tie_left)
    both = (_previous(df, "link") == FORWARD) & (F.col("link") == BACK)
    df = df.withColumn("_cut", F.when(both, F.when(cut_left, "left").otherwise("right")))
    gone = (F.col("_cut") == "right") | (F.lead("_cut").over(order) == "left")
    return df.withColumn("link", F.when(F.coalesce(gone, F.lit(False)), NONE).otherwise(F.col("link"))).drop("_cut")


def mark_sources_and_sinks(df: DataFrame) -> DataFrame:
    """A source has no link into it, a sink none out of it; a lone point is both."""
    before = _previous(df, "link")
    return df.withColumns({"is_source": (before != FORWARD) & (F.col("link") != BACK), "is_sink": (before != BACK) & (F.col("link") != FORWARD)})


def connect_sources(df: DataFrame, gap: int) -> DataFrame:
    """Numbers the chains of sources at most ``gap`` apart as ``group``, for every point of the sources' islands."""
    order = _order(df)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    source = F.when(F.col("is_source"), F.col("pos"))
    df = df.withColumn("_last", F.last(source, ignorenulls=True).over(earlier))
    df = df.withColumn("_new", (F.col("is_source") & F.coalesce(F.col("pos") - F.col("_last") > gap, F.lit(True))).cast("int"))
    df = df.withColumn("_group", F.when(F.col("is_source"), F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return df.withColumn("group", F.max("_group").over(_whole("island"))).drop("_last", "_new", "_group")


def resolve_sources(df: DataFrame) -> DataFrame:
    """``adj``: of each group's sources the position of the heaviest, the upstream one of equals."""
    up = F.when(F.col("strand") == "-", F.col("pos")).otherwise(-F.col("pos"))
    best = F.max(F.when(F.col("is_source"), F.struct("abund", up.alias("up"), F.col("pos").alias("p")))).over(Window.partitionBy(*KEYS, "group"))
    return df.withColumn("adj", best["p"])


def linked(df: DataFrame, min_gap: int, sata_gap: int, bias: str) -> DataFrame:
    """Links after the satellite passes and the cuts, with islands, sources and sinks."""
    df = initial_links(df, min_gap, bias)
    for gap in _satellite_gaps(min_gap, sata_gap):
        df = connect_satellites(df, gap)
    return mark_sources_and_sinks(with_islands(break_paths(df, bias)))


def called_sites(sites: DataFrame, counts_col: str | None = None, min_gap: int = 1, sata_gap: int = 5) -> DataFrame:
    """seqnames, strand, pos and adj of every observed 5' position."""
    found = linked(points(sites, five_prime(), counts_col, max(min_gap, sata_gap), min_gap, sata_gap, "upstream"), min_gap, sata_gap, "upstream")
    return resolve_sources(connect_sources(found, sata_gap)).select("seqnames", "strand", "pos", "adj")


def called_breaks(sites: DataFrame, counts_col: str | None = None, min_gap: int = 1, sata_gap: int = 3) -> DataFrame:
    """seqnames, strand, pos and adj of every observed 3' position."""
    found = linked(points(sites, three_prime(), counts_col, max(min_gap, sata_gap), min_gap, sata_gap, "downstream"), min_gap, sata_gap, "downstream")
    source = F.max(F.when(F.col("is_source"), F.col("pos"))).over(_whole("island"))
    return found.withColumn("adj", source).select("seqnames", "strand", "pos", "adj")


def _written(sites: DataFrame, calls: DataFrame, pos: Column, moves_start: str, details: bool) -> DataFrame:
    """Every row, moved to its call; a row without a sequence or position has none and stays as it is."""
    calls = calls.select(F.col("seqnames").alias("on"), F.col("strand").alias("side"), F.col("pos").alias("called_pos"), F.col("adj").alias("adj_pos"))
    rows = packed(sites, seqnames=F.col("seqnames"), strand=F.col("strand"), pos=pos.cast("bigint"))
    tasks = tasks_for(rows)
    rows, calls = rows.repartition(tasks, "pos", "seqnames", "strand"), calls.repartition(tasks, "called_pos", "on", "side")
    own = (F.col("pos") == F.col("called_pos")) & (F.col("seqnames") == F.col("on")) & (F.col("strand") == F.col("side"))
    out = rows.join(calls, own, "left")
    kind = dict(sites.dtypes)
    at = lambda name, moves: F.when(moves & F.col("adj_pos").isNotNull(), F.col("adj_pos")).otherwise(F.col("row")[name]).cast(kind[name])
    plus = (F.col("strand") == "+") if moves_start == "+" else (F.col("strand") != "+")
    row = F.col("row").withField("start", at("start", plus)).withField("end", at("end", ~plus))
    return out.select(row.alias("row"), "called_pos", "adj_pos").select("row.*", *(["called_pos", "adj_pos"] if details else []))


def standardize_sites(sites: DataFrame, counts_col: str | None = None, min_gap: int = 1, sata_gap: int = 5, details: bool = False) -> DataFrame:
    """The rows with their 5' position moved to the consensus of its cluster; ``details`` adds called_pos and adj_pos.

    As many rows come out as go in, in no order: rows without a sequence or position stay as they are, with null details; a
    strand other than + or - (null as well) raises; repeated rows count each; an empty table gives an empty result.
    """
    calls = called_sites(sites, counts_col, min_gap, sata_gap)
    return _written(sites, calls, five_prime(), "+", details)


def refine_breakpoints(sites: DataFrame, counts_col: str | None = None, min_gap: int = 1, sata_gap: int = 3, details: bool = False) -> DataFrame:
    """The rows with their 3' position moved to the consensus of its cluster; odd rows as in ``standardize_sites``."""
    calls = called_breaks(sites, counts_col, min_gap, sata_gap)
    return _written(sites, calls, three_prime(), "-", details)
