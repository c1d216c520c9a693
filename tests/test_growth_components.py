"""What a task holds, and how often a table is read, must not grow with the rows: components and multi-hits."""

from pyspark.sql import functions as F

from sitefold.operators import components, multihits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_made_once(spark):
    """The labels come from what was kept of the edges: their own plan is not run again."""
    edges = spark.range(50).select(F.col("id").cast("string").alias("u"), (F.col("id") - F.col("id") % 3).cast("string").alias("v"))
    labels = components.components(edges)
    assert "Range" not in plan(labels) and labels.count() == 50


def test_numbers_within_groups(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 700).cast("string").alias("label"))
    got = components.numbered(rows, number="c", by="g")
    want = rows.distinct().selectExpr("g", "label", "cast(dense_rank() over (partition by g order by label) as bigint) c")
    assert got.count() == want.count() and not got.exceptAll(want).count()


def test_single_values_are_loops(spark):
    pairs = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "3"), ("c", "3"), ("d", None)], "key string, val string")
    found = components.star_edges(pairs, "key", "val")
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("b", "a"), ("b", "b"), ("c", "c")]
    assert {r.key: r.clus for r in components.cluster_kv(pairs, returns="standard").collect()} == {"a": 1, "b": 1, "c": 2, "d": None}


def test_median_lengths(spark):
    """Reads with one to nine alignments, of odd and even numbers, and one without a length."""
    rows = [("chr1", 100 * i, 100 * i + w, "+", f"k{i}", f"r{i}") for i in range(1, 10) for w in range(3, 3 + 2 * i, 2)] + [("chr1", 5000, None, "+", "k0", "r0")]
    df = spark.createDataFrame(rows, "seqnames string, start long, end long, strand string, readPairKey string, ID string")
    want = df.groupBy("ID").agg(F.rint(F.percentile((F.col("end") - F.col("start") + 1).cast("double"), F.lit(0.5))).cast("bigint").alias("m"))
    want = sorted((r.m is not None, r.m or 0) for r in want.collect())
    found = multihits.cluster_multihits(df)["clusteredMultihitLengths"]
    assert "percentile" not in plan(found).lower()
    assert sorted((r.length is not None, r.length or 0) for r in found.collect() for _ in range(r["count"])) == want
