"""Scans of two sets of sites for stretches where one of them prevails."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefold.schema import CORE, five_prime, require


def scan_points(sites: DataFrame, grouping: str | None = None) -> DataFrame:
    """chr and pos of the distinct (chr, pos, group): a position in two groups appears twice."""
    require(sites, *CORE, *([grouping] if grouping else []))
    # positions on strand * are anchored like +
    rows = sites.select(F.col("seqnames").alias("chr"), five_prime().alias("pos"), (F.col(grouping) if grouping else F.lit("")).alias("grp"))
    return rows.distinct().select("chr", "pos")


def scan_format(query: DataFrame, subject: DataFrame, grouping: str | None = None) -> DataFrame:
    """chr, pos and grp (0: query, 1: subject), sorted by chr and pos."""
    both = scan_points(query, grouping).withColumn("grp", F.lit(0)).unionByName(scan_points(subject, grouping).withColumn("grp", F.lit(1)))
    return both.orderBy("chr", "pos", "grp")


def binomial_limits(k: int, share: float, tail: float) -> tuple[int, int]:
    """Greatest count of at most ``tail`` / 2 below it, and least count of at most that above it, for k draws (-1 and k + 1: none)."""
    chance = [math.comb(k, i) * share**i * (1 - share) ** (k - i) for i in range(k + 1)]
    low = max((i for i in range(k + 1) if sum(chance[: i + 1]) <= tail / 2), default=-1)
    high = min((i for i in range(k + 1) if sum(chance[i:]) <= tail / 2), default=k + 1)
    return low, high


def scan_clusters(points: DataFrame, kvals: tuple[int, ...] = (15, 25, 35), tail: float = 0.001) -> DataFrame:
    """Stretches of a sequence where one of two sets prevails, from (chr, pos, grp) as ``scan_format`` gives them.

    A window of k neighbouring points is marked if its count of set 1 lies in a tail of the binomial distribution with the
    overall share of that set.  Marked windows of one direction that overlap are one cluster: chr, start, end,
    direction (1: set 1 prevails, -1: set 0) and windows, their number.
    """
    total = points.agg(F.avg(F.col("grp").cast("double"))).first()[0]
    if total is None:
        return points.sparkSession.createDataFrame([], "chr string, start bigint, end bigint, direction int, windows bigint")
    order = Window.partitionBy("chr").orderBy("pos", "grp")
    marked = []
    for k in kvals:
        low, high = binomial_limits(k, total, tail)
        ahead = order.rowsBetween(0, k - 1)
        seen = points.select("chr", F.col("pos").alias("start"), F.max("pos").over(ahead).alias("end"), F.sum("grp").over(ahead).alias("n"), F.count("*").over(ahead).alias("k"))
        direction = F.when(F.col("n") >= high, 1).when(F.col("n") <= low, -1)
        marked.append(seen.filter(F.col("k") == k).select("chr", "start", "end", direction.alias("direction")).filter("direction is not null"))
    windows = reduce(DataFrame.unionByName, marked)
    run = Window.partitionBy("chr", "direction").orderBy("start", "end")
    reach = F.max("end").over(run.rowsBetween(Window.unboundedPreceding, -1))
    named = windows.withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    named = named.withColumn("_c", F.sum("_new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    out = named.groupBy("chr", "direction", "_c").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("windows"))
    return out.select("chr", "start", "end", "direction", "windows")
