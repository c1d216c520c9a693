"""Physical plans: no nested-loop joins, no Python, pruned scans."""

import re

import pytest
from pyspark.sql import functions as F

from sitefold.operators.abundance import condense_intsites, determine_abundance
from sitefold.operators.islands import serial_cluster
from sitefold.operators.legacy import cluster_values, normalize_intsite_positions
from sitefold.operators.standardize import refine_breakpoints, standardize_sites
from sitefold.operators.track import track_clones
from sitefold.operators.unique import unique_granges

OPERATORS = {
    "standardize": lambda s: standardize_sites(s, "counts"),
    "refine": refine_breakpoints,
    "abundance": lambda s: determine_abundance(s, "sample"),
    "condense": lambda s: condense_intsites(s, "sample", True, order_by=("start", "end", "counts")),
    "serial": lambda s: serial_cluster(s, (1,)),
    "modal": lambda s: normalize_intsite_positions(s, 2),
    "track": lambda s: track_clones(s, 5, origin="sample"),
    "unique": lambda s: unique_granges(s, sum_cols=True),
    "legacy": lambda s: cluster_values(s.withColumn("p", F.concat("seqnames", "strand")), "p", "start", "sample", "counts"),
}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "sites.parquet")
    rows = spark.range(2000).select(
        F.concat(F.lit("chr"), (F.col("id") % 3).cast("string")).alias("seqnames"), (F.col("id") * 3 % 977).alias("start"), (F.col("id") * 3 % 977 + 40).alias("end"),
        F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("id") % 4).cast("string").alias("sample"), (F.col("id") % 5 + 1).alias("counts"), F.lit("x").alias("unused"),
    )
    rows.write.parquet(path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_joins_and_python(spark, table, name):
    found = plan(OPERATORS[name](spark.read.parquet(table)))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Arrow", found)


def test_columns_are_pruned(spark, table):
    found = plan(determine_abundance(spark.read.parquet(table), "sample"))
    assert found.count("ReadSchema") >= 1 and "unused" not in found and "counts" not in found


def test_one_exchange_for_all_phases(spark, table):
    """The windows of all phases of a chain share the exchange on (seqnames, strand, chain)."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = plan(standardize_sites(spark.read.parquet(table)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    own = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", found) if "chain" in x]
    assert len(own) == 1 and found.count("Window [") > 20
