"""Sites and pairs derived from the benchmark tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site read for each line item."""
    pos, length = 1000 + 11 * F.col("l_partkey") + F.col("l_linenumber"), 30 + F.col("l_quantity").cast("bigint")
    plus = F.col("l_linestatus") == "O"
    return load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("seqnames"),
        F.when(plus, pos).otherwise(pos - length + 1).alias("start"),
        F.when(plus, pos + length - 1).otherwise(pos).alias("end"),
        F.when(plus, "+").otherwise("-").alias("strand"),
        F.col("l_returnflag").alias("sample"),
        (F.col("l_linenumber") % 4).alias("replicate"),
        F.col("l_quantity").cast("bigint").alias("counts"),
    )


SITES = """sites AS (
  SELECT seqnames, CASE WHEN strand = '+' THEN p ELSE p - w + 1 END AS "start", CASE WHEN strand = '+' THEN p + w - 1 ELSE p END AS "end",
         strand, sample, replicate, counts,
         p AS five, CASE WHEN strand = '+' THEN p + w - 1 ELSE p - w + 1 END AS three, w AS width,
         seqnames || strand || CAST(p AS VARCHAR) AS posid
  FROM (SELECT 'chr' || CAST(l_suppkey % 3 + 1 AS VARCHAR) AS seqnames, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
               1000 + 11 * l_partkey + l_linenumber AS p, 30 + CAST(l_quantity AS BIGINT) AS w,
               l_returnflag AS sample, l_linenumber % 4 AS replicate, CAST(l_quantity AS BIGINT) AS counts
        FROM lineitem))"""


def database_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a site database returns them."""
    s = sites(spark, sf_dir)
    plus = F.col("strand") == "+"
    return s.select(
        F.col("seqnames").alias("chr"),
        F.when(plus, F.col("start")).otherwise(F.col("end")).alias("position"),
        F.when(plus, F.col("end")).otherwise(F.col("start")).alias("breakpoint"),
        "strand",
        F.concat(F.lit("SMP"), "sample", F.lit("-"), F.col("replicate").cast("string")).alias("sampleName"),
        (F.col("counts") > 25).alias("isMulti"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (keys) that share a part in one quantity at one discount, of all line items."""
    shared = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("bigint").cast("string"), F.round(F.col("l_discount") * 100).cast("bigint").cast("string"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), shared.alias("val")).distinct()


PAIRS = """pr AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS k,
  CAST(l_partkey AS VARCHAR) || ':' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) AS v FROM lineitem)"""


def multihits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a read that aligns where its part and quantity say; an order's reads share a pair key."""
    pos, length = 1000 + 2000 * F.col("l_partkey") + 40 * F.col("l_quantity").cast("bigint"), 30 + F.col("l_linenumber")
    plus = F.col("l_linestatus") == "O"
    key = F.concat(F.lit("r"), F.col("l_orderkey").cast("string"))
    return load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("seqnames"),
        F.when(plus, pos).otherwise(pos - length + 1).alias("start"),
        F.when(plus, pos + length - 1).otherwise(pos).alias("end"),
        F.when(plus, "+").otherwise("-").alias("strand"),
        F.col("l_returnflag").alias("sample"),
        key.alias("readPairKey"),
        F.concat(key, F.lit(":"), (F.col("l_linenumber") % 3).cast("string")).alias("ID"),
        key.alias("multihitid"),
    )


MULTIHITS = """multihits AS (
  SELECT seqnames, CASE WHEN strand = '+' THEN p ELSE p - w + 1 END AS "start", CASE WHEN strand = '+' THEN p + w - 1 ELSE p END AS "end", strand, sample, k AS readPairKey,
         k || ':' || CAST(n % 3 AS VARCHAR) AS ID, k AS multihitid, p AS five, w AS width, seqnames || strand || CAST(p AS VARCHAR) AS posid
  FROM (SELECT 'chr' || CAST(l_suppkey % 3 + 1 AS VARCHAR) AS seqnames, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
               1000 + 2000 * l_partkey + 40 * CAST(l_quantity AS BIGINT) AS p, 30 + l_linenumber AS w, l_returnflag AS sample, 'r' || CAST(l_orderkey AS VARCHAR) AS k, l_linenumber AS n
        FROM lineitem))"""


def abundances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One population for each event type: the users' numbers of events."""
    return load(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("x")).select("event_type", "x")


ABUNDANCES = "pop AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY event_type, user_id)"
