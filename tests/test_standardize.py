"""The window phases against the graph simulation, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from sitefold.operators import islands, standardize
from sitefold.operators.legacy import normalize_intsite_positions, standardize_by_window
from tests import golden as G
from tests.simulate import snap

SCHEMA = "seqnames string, start long, end long, strand string, counts long"


def random_points(seed, n_cases=25):
    """One random case a sequence name."""
    rng = random.Random(seed)
    rows, cases = [], {}
    for k in range(n_cases):
        points, base = {}, rng.randrange(1, 1 << 15)
        for _ in range(rng.randrange(1, 22)):
            base += rng.choice([1, 1, 1, 2, 2, 3, 4, 5, 6, 9])
            points[rng.choice("+-"), base] = rng.randrange(1, 5)
        cases[f"s{k}"] = points
        rows += [(f"s{k}", p, p, s, a) for (s, p), a in points.items()]
    return rows, cases


@pytest.mark.parametrize(("min_gap", "sata_gap"), [(1, 5), (0, 3), (1, 2), (0, 6)])
def test_sites_match_the_simulation(spark, min_gap, sata_gap):
    rows, cases = random_points(min_gap * 10 + sata_gap)
    got = standardize.called_sites(spark.createDataFrame(rows, SCHEMA), "counts", min_gap, sata_gap).collect()
    found = {(r.seqnames, r.strand, r.pos): r.adj for r in got}
    assert found == {(k, *at): adj for k, points in cases.items() for at, adj in snap(points, min_gap, sata_gap, True, "upstream").items()}


@pytest.mark.parametrize(("min_gap", "sata_gap"), [(1, 3), (0, 4)])
def test_breaks_match_the_simulation(spark, min_gap, sata_gap):
    rows, cases = random_points(100 + min_gap * 10 + sata_gap)
    got = standardize.called_breaks(spark.createDataFrame(rows, SCHEMA), "counts", min_gap, sata_gap).collect()
    found = {(r.seqnames, r.strand, r.pos): r.adj for r in got}
    assert found == {(k, *at): adj for k, points in cases.items() for at, adj in snap(points, min_gap, sata_gap, False, "downstream").items()}


def test_mirror(spark):
    sites = G.f1(spark)
    mirror = sites.select("row_id", "seqnames", (2000 - F.col("end")).alias("start"), (2000 - F.col("start")).alias("end"), F.lit("-").alias("strand"))
    plain = [r.start for r in standardize.standardize_sites(sites).orderBy("row_id").collect()]
    turned = [2000 - r.end for r in standardize.standardize_sites(mirror).orderBy("row_id").collect()]
    assert plain == turned


def test_details_and_counts(spark):
    out = standardize.standardize_sites(G.f1(spark), details=True)
    assert out.columns[-2:] == ["called_pos", "adj_pos"]
    assert [r.called_pos for r in out.orderBy("row_id").collect()] == G.F1_START
    heavy = G.f1(spark).withColumn("counts", F.when(F.col("start") == 602, 50).otherwise(1))
    assert {r.start for r in standardize.standardize_sites(heavy, "counts").filter("row_id <= 20").collect()} == {602}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert standardize.standardize_sites(empty).count() == 0 and standardize.refine_breakpoints(empty).count() == 0
    one = spark.createDataFrame([("chr1", 5, 9, "-", None)], SCHEMA)
    assert tuple(standardize.standardize_sites(one, "counts").first())[:4] == ("chr1", 5, 9, "-")
    level = spark.createDataFrame([("chr1", p, p + 40, "+", 1) for p in range(10, 15)], SCHEMA)
    assert {r.start for r in standardize.standardize_sites(level).collect()} == {10}
    with pytest.raises(ValueError, match="missing columns"):
        standardize.standardize_sites(empty, "absent")
    star = spark.createDataFrame([("chr1", 5, 9, "*", 1)], SCHEMA)
    with pytest.raises(Exception, match="strand"):
        standardize.standardize_sites(star).collect()


def test_chains_cross_bins(spark):
    edge = islands.BIN
    pos = [edge - 3, edge - 1, edge, edge + 1, 2 * edge - 1, 2 * edge + 4, 3 * edge, 3 * edge + 9]
    df = spark.createDataFrame([("c", p) for p in pos], "k string, p long")
    found = {r.p: r.island for r in islands.chains(df, ["k"], "p", 5).collect()}
    assert [found[p] for p in pos] == [edge - 3] * 4 + [2 * edge - 1] * 2 + [3 * edge, 3 * edge + 9]
    dense = spark.createDataFrame([("c", p) for p in range(0, 4 * edge, 512)], "k string, p long")
    assert {r.island for r in islands.chains(dense, ["k"], "p", 512).collect()} == {0}


def test_serial_and_graph_clusters(spark):
    rows = [(i, "chr1", s, s + 19 + i, "+") for i, s in enumerate((50, 49, 44, 50, 50, 50, 60))]
    sites = spark.createDataFrame(rows, "row_id long, seqnames string, start long, end long, strand string")
    out = islands.serial_cluster(sites, (1, 5, 10)).orderBy("row_id").collect()
    assert [r.clusID_1nt for r in out] == [2, 2, 1, 2, 2, 2, 3]
    assert [r.clusID_5nt for r in out] == [1] * 6 + [2]
    assert [r.clusID_10nt for r in out] == [1] * 7
    edges = {tuple(r) for r in islands.graph_clusters(sites, 5).collect()}
    assert edges == {(2, i) for i in range(6)} | {(6, 6)}


def test_older_methods(spark):
    sites = spark.createDataFrame([("chr1", s, s + 40, "+") for s in (10, 10, 12, 30)], "seqnames string, start long, end long, strand string")
    assert sorted(r.start for r in standardize_by_window(sites).collect()) == [10, 10, 10, 30]
    out = normalize_intsite_positions(sites, 3).collect()
    assert sorted(r.norm_pos for r in out) == [10, 10, 10, 30]
