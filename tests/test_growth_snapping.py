"""What a task holds, and how often a table is read, must not grow with the rows: consensus positions."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitefold.operators import standardize
from sitefold.schema import five_prime


def test_tasks_of_the_snapping_grow_with_the_rows(spark):
    def parts(n):
        rows = spark.range(n).select(F.lit("chr1").alias("seqnames"), (F.col("id") * 9).alias("start"), (F.col("id") * 9 + 40).alias("end"), F.lit("+").alias("strand"))
        return standardize.points(rows, five_prime(), None, 5).rdd.getNumPartitions()

    small, large = parts(1000), parts(1_500_000)
    assert small <= spark.sparkContext.defaultParallelism and large >= 15


def dense(spark, seed, n=60_000):
    """Points within the gap all along a chromosome, and random counts: one chain over several bins."""
    steps = [[1, 2, 3, 5], [2, 5], [1, 1, 5], [5]][seed % 4]
    step = F.element_at(F.array(*[F.lit(x) for x in steps]), (F.pmod(F.hash("id", F.lit(seed)), F.lit(len(steps))) + 1).cast("int"))
    pos = F.sum(step).over(Window.orderBy("id"))
    rows = spark.range(n).select(pos.alias("start"), F.pmod(F.hash("id", F.lit(seed + 100)), F.lit(9)).alias("n"))
    return rows.select(F.lit("chr1").alias("seqnames"), "start", (F.col("start") + 30).alias("end"), F.lit("-" if seed % 2 else "+").alias("strand"), (F.col("n") + 1).alias("n"))


@pytest.mark.parametrize(("seed", "halo"), [(0, 64), (1, standardize.HALO), (2, 64)])
def test_long_chains_are_cut_without_a_change(spark, seed, halo, monkeypatch):
    monkeypatch.setattr(standardize, "HALO", halo)
    sites = dense(spark, seed, 30_000).localCheckpoint()
    apart = [standardize.called_sites(sites, "n"), standardize.called_breaks(sites, "n", 1, 5)]
    monkeypatch.setattr(standardize, "safe_starts", lambda df, *_: df.withColumn("fresh", F.lit(False)))
    whole = [standardize.called_sites(sites, "n"), standardize.called_breaks(sites, "n", 1, 5)]
    for a, b in zip(apart, whole):
        assert a.count() == b.count() == 30_000
        assert a.exceptAll(b).isEmpty()


def test_no_task_holds_a_long_chain(spark):
    """Chains of neighbours, which the windows of a task hold, do not grow with the covered stretch."""
    def longest(n):
        found = standardize.points(dense(spark, 0, n), five_prime(), "n", 5)
        return found.groupBy("chain").count().agg(F.max("count")).first()[0]

    assert longest(60_000) < 1000 and longest(240_000) < 1000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_are_not_left_to_the_sessions_partitions(spark):
    """A task's table of sums does not grow with the rows: all points are dealt over tasks that follow the rows."""
    name, side = F.concat(F.lit("chr"), F.col("id") % 3), F.when(F.col("id") % 2 == 0, "+").otherwise("-")
    rows = spark.range(1_500_000).select(name.alias("seqnames"), (F.col("id") * 9).alias("start"), (F.col("id") * 9 + 40).alias("end"), side.alias("strand"))
    dealt = re.findall(r"hashpartitioning\(.*, (\d+)\)", plan_of(standardize.called_sites(rows)))
    assert dealt and min(map(int, dealt)) >= 15


def test_one_sort_a_pass(spark):
    """Each sort holds a page of its task at least; links, four passes and sources, and groups take one each."""
    rows = spark.createDataFrame([("chr1", p, p + 40, "+", 1 + p % 3) for p in (1, 2, 4, 9, 30)], "seqnames string, start long, end long, strand string, n long")
    found = standardize.connect_sources(standardize.linked(standardize.points(rows, five_prime(), "n", 5), 1, 5, "upstream"), 5)
    sorts = lambda df: len(re.findall(r"Sort \[[^\]]*\bchain\b", plan_of(df)))
    assert sorts(found) <= 6 and sorts(standardize.called_sites(rows, "n")) <= 7
    assert sorts(standardize.standardize_sites(rows, details=True)) <= 7
