"""What a task holds, and how often a table is read, must not grow with the rows: the estimate of abundance."""

from pyspark.sql import functions as F

from sitefold.operators import abundance


def test_rounds_run_over_sets_of_lengths(spark, monkeypatch):
    """500 positions with one set of lengths and 500 with another are two rows of state, not 1000."""
    rows = spark.range(1000).select(
        F.lit("chr1").alias("seqnames"), (F.col("id") * 100).alias("start"), F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit(5))).otherwise(F.array(F.lit(5), F.lit(9)))).alias("w"),
        F.lit("+").alias("strand"), F.lit("a").alias("sample"),
    ).withColumn("end", F.col("start") + F.col("w"))
    kept = []

    def durable(df):
        held = df.checkpoint(eager=True)
        kept.append((set(df.columns), held.count()))
        return held

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    monkeypatch.setattr(abundance, "durable", durable)
    found = abundance.estimated_lengths(rows, "sample", rounds=3, tolerance=0)
    assert found.count() == 1000 and found.select("estAbund").distinct().count() == 2
    rounds = [n for columns, n in kept if "theta" in columns]
    assert len(rounds) == 4 and max(rounds) == 3


def test_estimate_keeps_rows_without_a_group(spark):
    rows = spark.createDataFrame([("chr1", 1, 9, "+", None), ("chr1", 1, 10, "+", None), ("chr1", 50, 60, "+", "a")], "seqnames string, start int, end int, strand string, sample string")
    assert {r.group for r in abundance.estimated_lengths(rows, "sample", rounds=2).collect()} == {None, "a"}
