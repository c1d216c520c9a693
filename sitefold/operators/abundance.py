"""Clone abundance and condensed sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefold.checkpoints import durable
from sitefold.functions.ids import posid
from sitefold.schema import CORE, five_prime, packed, require, width

#: Group of tables without a grouping column.
ONE_GROUP = "group1"

#: Up to so many cells of all groups their shares are broadcast.
FEW_CELLS = 200_000


def _base(sites: DataFrame, grouping: str | None, replicates: str | None) -> DataFrame:
    require(sites, *CORE, *[c for c in (grouping, replicates) if c])
    return sites.select(
        posid().alias("posid"),
        (F.col(grouping).cast("string") if grouping else F.lit(ONE_GROUP)).alias("group"),
        width().alias("width"),
        (F.col(replicates).cast("string") if replicates else F.lit("1")).alias("replicate"),
    )


def _ranked(abundance: DataFrame) -> DataFrame:
    """Adds relAbund and relRank (the larger rank of equals).

    Both come from each group's histogram of rounded abundances, which is small however many sites a group has.
    """
    rounded = abundance.withColumn("_r", F.rint(F.col("estAbund").cast("double")))
    bars = rounded.groupBy("group", "_r").agg(F.count("*").alias("n"), F.sum("estAbund").alias("s"))
    down = Window.partitionBy("group").orderBy(F.desc("_r")).rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("group")
    bars = bars.select(
        F.col("group").alias("_g"), F.col("_r").alias("_e"), F.sum("n").over(down).cast("bigint").alias("relRank"), (F.col("_r") / F.sum("s").over(whole)).alias("relAbund")
    )
    same = F.col("group").eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_e"))
    return rounded.join(bars, same).select("posid", "group", "estAbund", "relAbund", "relRank")


def fragment_lengths(sites: DataFrame, grouping: str | None = None, replicates: str | None = None) -> DataFrame:
    """The number of distinct (width, replicate) of each group's position."""
    lengths = _base(sites, grouping, replicates).distinct()
    return lengths.groupBy("posid", "group").agg(F.count("*").alias("estAbund"))


def estimated_lengths(
    sites: DataFrame, grouping: str | None = None, replicates: str | None = None, rounds: int = 20, tolerance: float = 1e-9
) -> DataFrame:
    """Expected numbers of fragments, by expectation-maximisation (Berry et al., 2012).

    The fragments of site i and length j are Poisson with mean theta_i phi_j, and only whether there are any is
    seen.  A seen pair stands for x / (1 - exp(-x)) fragments at x = theta_i phi_j; theta are their sums by
    site and phi their shares by length, and replicate if there are several.  Rounds end once no theta changes by more than
    ``tolerance`` of itself, or after ``rounds`` (0 as tolerance: exactly that many).
    """
    pairs = _base(sites, grouping, replicates).select("posid", "group", F.concat_ws("|", "width", "replicate").alias("cell"))
    # positions of a group with the same cells have the same theta in every round: the rounds run over the distinct sets of cells
    places = durable(pairs.groupBy("posid", "group").agg(F.array_sort(F.collect_set("cell")).alias("cells")))
    sets = places.groupBy("group", "cells").agg(F.count("*").alias("n"))
    sets = durable(sets.withColumn("id", F.monotonically_increasing_id()))
    now = sets.select("id", "group", "n", F.size("cells").cast("double").alias("theta"), F.explode("cells").alias("cell"))
    seen = now.groupBy("group", "cell").agg(F.sum("n").alias("s"))
    few = seen.count() <= FEW_CELLS
    now = durable(_with_shares(now, seen, few))
    mean = F.col("theta") * F.col("phi")
    for _ in range(rounds):
        x = now.select("id", "group", "cell", "n", "theta", (mean / (1 - F.exp(-mean))).alias("x"))
        by_set = x.groupBy("id").agg(F.sum("x").alias("next"))
        by_cell = x.groupBy("group", "cell").agg(F.sum(F.col("n") * F.col("x")).alias("s"))
        moved = x.join(by_set, "id").select("id", "group", "cell", "n", F.col("theta").alias("before"), F.col("next").alias("theta"))
        # a round uses its predecessor several times, so each one is kept
        moved = durable(_with_shares(moved, by_cell, few))
        now = moved.drop("before")
        if tolerance and (moved.agg(F.max(F.abs(F.col("theta") / F.col("before") - 1))).first()[0] or 0.0) <= tolerance:
            break
    found = sets.join(now.groupBy("id").agg(F.max("theta").alias("estAbund")), "id").select(F.col("group").alias("g"), F.col("cells").alias("c"), "estAbund")
    same = F.col("group").eqNullSafe(F.col("g")) & (F.col("cells") == F.col("c"))
    return places.join(found, same).select("posid", "group", "estAbund")


def _with_shares(rows: DataFrame, sums: DataFrame, few: bool) -> DataFrame:
    """``rows`` with phi, their cell's share of its group's sum."""
    total = sums.groupBy("group").agg(F.sum("s").alias("all")).select(F.col("group").alias("g"), "all")
    same = F.col("group").eqNullSafe(F.col("g"))
    shares = sums.join(total, same).select(F.col("group").alias("g"), F.col("cell").alias("c"), (F.col("s") / F.col("all")).alias("phi"))
    return rows.join(F.broadcast(shares) if few else shares, same & (F.col("cell") == F.col("c"))).drop("g", "c")


METHODS = {"fragLen": fragment_lengths, "estAbund": estimated_lengths}


def determine_abundance(sites: DataFrame, grouping: str | None = None, replicates: str | None = None, method: str = "fragLen", **options) -> DataFrame:
    """posid, group, estAbund, relAbund (of the group's total) and relRank of every position; options go to the method."""
    if method not in METHODS:
        raise ValueError(f"determine_abundance: unknown method {method!r}")
    return _ranked(METHODS[method](sites, grouping, replicates, **options))


def condense_intsites(
    sites: DataFrame, grouping: str | None = None, return_abundance: bool = False, method: str = "fragLen", replicates: str | None = None, order_by: tuple[str, ...] = ("row_id",)
) -> DataFrame:
    """The first row, by ``order_by``, of each position in each group, as one base; optionally with its abundance."""
    require(sites, *CORE, *order_by, *[c for c in (grouping, replicates) if c])
    # the first row by an aggregate, which combines before the shuffle and holds one row a position
    key = F.struct(*[F.col(f"`{c}`") for c in order_by])
    named = packed(sites, posid=posid(), group=F.col(grouping).cast("string") if grouping else F.lit(ONE_GROUP), key=key, at=five_prime())
    first = named.groupBy("posid", "group").agg(F.min_by("row", "key").alias("row"), F.max("at").alias("at"))
    kind = dict(sites.dtypes)
    row = F.col("row").withField("start", F.col("at").cast(kind["start"])).withField("end", F.col("at").cast(kind["end"]))
    out = first.select(row.alias("row"), F.col("posid").alias("place"), F.col("group").alias("of"))
    if not return_abundance:
        return out.select("row.*", F.col("place").alias("posid"))
    found = determine_abundance(sites, grouping, replicates, method)
    joined = out.join(found, F.col("place").eqNullSafe(F.col("posid")) & F.col("of").eqNullSafe(F.col("group")), "left")
    return joined.select("row.*", "estAbund", "relAbund", "relRank", F.col("place").alias("posid"))
