"""Null keys, clashing column names and empty tables: what goes in comes out."""

import math

import pytest
from pyspark.sql import functions as F

from sitefold import checkpoints
from sitefold.functions.ids import posid
from sitefold.operators import abundance, islands, legacy, multihits, standardize, track

CLASHES = ["_s", "_t", "_p", "_o", "_g", "_pos", "_at", "pos", "row", "chain", "called", "o", "on", "side", "link"]
ROWS = [("chr1", 10, 40, "+", "a"), ("chr1", 11, 41, "+", "b"), ("chr1", 11, 41, "+", "b"), ("chr1", 30, 60, "-", "a"), (None, 10, 40, "+", "a"), ("chr1", None, 40, "+", "a"), ("chr1", 9, None, "-", None)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "seqnames string, start int, end int, strand string, sample string")
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(f"{c}{i}"))
    return df.withColumn("row_id", F.monotonically_increasing_id())


def core(df):
    return sorted(map(tuple, df.select("seqnames", "start", "end", "strand", "sample").collect()), key=repr)


@pytest.mark.parametrize("f", [standardize.standardize_sites, standardize.refine_breakpoints])
def test_snapping_keeps_all_rows(odd, f):
    out = f(odd, details=True)
    assert out.drop("called_pos", "adj_pos").columns == odd.columns and out.count() == len(ROWS)
    assert out.drop("called_pos", "adj_pos").schema == odd.schema or dict(out.drop("called_pos", "adj_pos").dtypes) == dict(odd.dtypes)
    assert {r["_s"] for r in out.collect()} == {"_s0"}
    assert f(odd.limit(0)).count() == 0


def test_snapped_positions(odd):
    out = core(standardize.standardize_sites(odd))
    assert out == sorted([("chr1", 11, 40, "+", "a"), ("chr1", 11, 41, "+", "b"), ("chr1", 11, 41, "+", "b"), ("chr1", 30, 60, "-", "a"), (None, 10, 40, "+", "a"), ("chr1", None, 40, "+", "a"), ("chr1", 9, None, "-", None)], key=repr)


def test_others_survive_clashes(odd):
    assert islands.serial_cluster(odd, (0, 5)).count() == len(ROWS)
    shared = track.track_clones(odd, 5, origin="sample")
    assert {(r.start, r.sample, r["_o"]) for r in shared.collect()} == {(10, "a", "_o3"), (11, "b", "_o3")}
    first = abundance.condense_intsites(odd, "sample", return_abundance=True)
    # rows without a sequence or position have one (null) id
    assert first.count() == odd.select(posid(), "sample").distinct().count()
    assert legacy.cluster_sites(odd.withColumn("Position", F.col("start")), grouping="sample").count() == len(ROWS)
    named = multihits.normalize_multihit_clusters(odd.withColumn("multihitid", F.col("sample")))
    assert named.count() == len(ROWS) and named.columns[:-1] == [*odd.columns, "multihitid"]


def test_estimate_rounds(odd):
    """The estimate against plain Python, and its end once it has settled."""
    rows = odd.filter("seqnames is not null and start is not null and end is not null")
    pairs = {(r.posid, str(r.w)) for r in rows.select(posid().alias("posid"), (F.col("end") - F.col("start") + 1).alias("w")).collect()}
    theta = {p: sum(q == p for q, _ in pairs) for p, _ in pairs}
    phi = {c: sum(d == c for _, d in pairs) / len(pairs) for _, c in pairs}
    for _ in range(2):
        x = {(p, c): theta[p] * phi[c] / (1 - math.exp(-theta[p] * phi[c])) for p, c in pairs}
        theta = {p: sum(v for (q, _), v in x.items() if q == p) for p in theta}
        phi = {c: sum(v for (_, d), v in x.items() if d == c) / sum(x.values()) for c in phi}
    got = {r.posid: r.estAbund for r in abundance.estimated_lengths(rows, rounds=2, tolerance=0).collect()}
    assert got.keys() == theta.keys() and all(abs(got[p] - theta[p]) < 1e-9 for p in got)
    settled = {r.posid: r.estAbund for r in abundance.estimated_lengths(rows, rounds=50, tolerance=100.0).collect()}
    assert all(abs(settled[p] - v) < 5 for p, v in theta.items())


def test_folder_must_be_shared_on_a_cluster():
    class Hadoop:
        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

        def sc(self):
            return self

    class Context:
        master, _jsc = "spark://host:7077", Hadoop()

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        checkpoints.shared_folder(Session())
