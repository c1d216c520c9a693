"""Abundance, sets, clusters, diversity, utilities and sources on small inputs."""

import gzip
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sitefold.functions import diversity, scoring, vectors
from sitefold.operators.abundance import condense_intsites, determine_abundance
from sitefold.operators.components import components
from sitefold.operators.legacy import cluster_sites, cluster_values
from sitefold.operators.multihits import cluster_multihits, normalize_multihit_clusters
from sitefold.operators.scan import binomial_limits, scan_clusters, scan_format
from sitefold.operators.track import track_clones
from sitefold.operators.unique import unique_granges
from sitefold.sources import fastq
from sitefold.sources.generate import generate_sites
from sitefold.streaming.abundance import stream_abundance

CORE = "seqnames string, start long, end long, strand string"


def test_components_against_union_find(spark):
    rng = random.Random(4)
    for shape in ("random", "path", "star", "loop"):
        edges = {
            "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)],
            "path": [(i, i + 1) for i in range(50)],
            "star": [(0, i) for i in range(1, 50)],
            "loop": [(5, 5)],
        }[shape]
        part = {x: x for e in edges for x in e}

        def root(x, part=part):
            while part[x] != x:
                x = part[x]
            return x

        for a, b in edges:
            part[max(root(a), root(b))] = min(root(a), root(b))
        got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: root(x) for x in part}


def test_abundance_options(spark):
    rows = [("c", 1, 10, "+", "a", 1), ("c", 1, 10, "+", "a", 2), ("c", 1, 10, "+", "b", 1), ("c", 5, 9, "+", "a", 1), ("c", 1, 10, "+", "a", 1)]
    sites = spark.createDataFrame(rows, CORE + ", g string, r int")
    got = {(r.posid, r.group): (r.estAbund, r.relRank) for r in determine_abundance(sites, "g", "r").collect()}
    assert got == {("c+1", "a"): (2, 1), ("c+5", "a"): (1, 2), ("c+1", "b"): (1, 1)}
    with pytest.raises(ValueError):
        determine_abundance(sites, "absent")
    with pytest.raises(ValueError):
        determine_abundance(sites, method="other")
    assert determine_abundance(sites.limit(0)).count() == 0
    first = condense_intsites(sites.withColumn("row_id", F.monotonically_increasing_id()), "g")
    assert first.count() == 3 and first.columns[-1] == "posid"


def test_estimated_abundance_against_plain_rounds(spark):
    rng = random.Random(2)
    pairs = sorted({(p, rng.randrange(30, 45)) for p in (1, 50, 99) for _ in range(rng.randrange(2, 30))})
    sites = spark.createDataFrame([("c", p, p + w - 1, "+") for p, w in pairs], CORE)
    theta = {p: float(sum(q == p for q, _ in pairs)) for p, _ in pairs}
    phi = {w: sum(v == w for _, v in pairs) / len(pairs) for _, w in pairs}
    for _ in range(20):
        x = {(p, w): theta[p] * phi[w] / (1 - math.exp(-theta[p] * phi[w])) for p, w in pairs}
        total = sum(x.values())
        theta = {p: sum(v for (q, _), v in x.items() if q == p) for p in theta}
        phi = {w: sum(v for (_, u), v in x.items() if u == w) / total for w in phi}
    got = {int(r.posid[2:]): r.estAbund for r in determine_abundance(sites, method="estAbund").collect()}
    assert got == {p: pytest.approx(v, rel=1e-6) for p, v in theta.items()}


def test_unique_options(spark):
    df = spark.createDataFrame([("c", 1, 2, "+", "x", 1, 1), ("c", 1, 2, "+", "x", 2, 2)], CORE + ", tag string, counts int, counts_b int")
    assert unique_granges(df, rm_cols=["counts", "counts_b"]).count() == 1
    with pytest.warns(UserWarning):
        assert unique_granges(df, rm_cols=["absent"]).count() == 2
    assert unique_granges(df, rm_dup_cols="^[a-z]+").columns == ["seqnames", "start", "end", "strand", "tag", "counts"]
    assert unique_granges(df.select("seqnames", "start", "end", "strand")).count() == 1
    with pytest.raises(ValueError):
        unique_granges(df, sum_cols=["absent"])


def test_track_clones_against_pairs(spark):
    rng = random.Random(7)
    sets = {n: [("c", rng.randrange(16300, 16480), rng.choice("+-*")) for _ in range(30)] for n in "abc"}
    frames = {n: spark.createDataFrame([(c, p, p, s) for c, p, s in v], CORE) for n, v in sets.items()}
    got = {(r.origin, r.start, r.strand) for r in track_clones(frames, 3).collect()}
    fits = lambda s, t: s == t or "*" in (s, t)
    want = {(n, p, s) for n, v in sets.items() for _, p, s in v if any(m != n and abs(p - q) <= 3 and fits(s, t) for m, w in sets.items() for _, q, t in w)}
    assert got == want
    assert track_clones([frames["a"]], 3).count() == 0


def test_multihits(spark):
    rows = [("chr1", 10, 40, "+", "k1", "i1"), ("chr1", 13, 41, "+", "k2", "i2"), ("chr2", 90, 100, "+", "k2", "i2"), ("chr2", 300, 310, "-", "k3", "i3")]
    hits = spark.createDataFrame(rows, CORE + ", readPairKey string, ID string")
    out = cluster_multihits(hits, 5)
    assert {r.readPairKey: r.multihitID for r in out["unclusteredMultihits"].collect()} == {"k1": 1, "k2": 1, "k3": 2}
    assert out["clusteredMultihitPositions"].count() == 4
    assert {tuple(r) for r in out["clusteredMultihitLengths"].collect()} == {(1, 31, 1), (1, 20, 1), (2, 11, 1)}
    rows = [(c, p, b, s, i, g) for g, ids in ((1, (1, 1, 2, 3)), (2, (4, 4, 5, 6))) for (c, p, b, s), i in zip((("chr1", 5, 9, "+"), ("chr2", 7, 9, "+"), ("chr2", 7, 9, "+"), ("chr3", 1, 2, "-")), ids, strict=True)]
    multi = spark.createDataFrame(rows, CORE + ", multihitid int, patient int")
    got = {r.multihitid: r["norm.multihitid"] for r in normalize_multihit_clusters(multi, grouping="patient").collect()}
    assert got == {1: "1:1", 2: "1:1", 3: "1:2", 4: "2:1", 5: "2:1", 6: "2:2"}


def test_older_clusters(spark):
    df = spark.createDataFrame([("p", 10, "g", 3), ("p", 12, "g", 5), ("p", 20, "g", 1), ("p", 22, "g", 1), ("p", 40, "g", 9)], "id string, v int, g string, w int")
    got = {r.value: (r.clusteredValue, r["clusteredValue.freq"]) for r in cluster_values(df, "id", "v", "g", "w").collect()}
    assert got == {10: (12, 8), 12: (12, 8), 20: (20, 2), 22: (20, 2), 40: (40, 9)}
    assert cluster_values(df, "id", "v", "g", "w", by_quartile=True).count() == 5
    sites = spark.createDataFrame([("c", "+", 10, 5, "x counts=4", False), ("c", "+", 12, 9, "y", False), ("c", "+", 11, 9, "z", True)], "seqnames string, strand string, Position int, score int, qName string, isMultiHit boolean")
    out = {r.Position: r for r in cluster_sites(sites, score="score").collect()}
    assert (out[12].clusteredPosition, out[12].clonecount, out[12].clusterTopHit, out[10].clusterTopHit) == (10, 5, True, False)
    assert out[11].clusteredPosition is None


def plain_indices(x, w=None):
    total = sum(x)
    p = [v / total for v in x]
    order = sorted(range(len(x)), key=lambda i: x[i])
    w = w or [1.0] * len(x)
    cw = list(itertools.accumulate(w[i] / sum(w) for i in order))
    cp = list(itertools.accumulate(x[i] * w[i] for i in order))
    cp = [c / cp[-1] for c in cp]
    return {
        "shannon": -sum(v * math.log(v) for v in p),
        "entropy": -sum(v * math.log2(v) for v in p),
        "clonality": 1 + sum(v * math.log(v, len(x)) for v in p),
        "gini": sum(cp[i + 1] * cw[i] - cp[i] * cw[i + 1] for i in range(len(x) - 1)),
        "uc50": sum(c >= total / 2 for c in itertools.accumulate(sorted(x))),
    }


def test_diversity(spark):
    rng = random.Random(3)
    groups = {"a": [float(rng.randrange(1, 9)) for _ in range(50)], "b": [float(rng.randrange(1, 100)) for _ in range(31)]}
    df = spark.createDataFrame([(g, v, float(i % 3 + 1)) for g, x in groups.items() for i, v in enumerate(x)], "g string, x double, w double")
    for name in diversity.CALCS:
        got = {r.g: r.value for r in diversity.pop_calcs(df, name, "x", ["g"]).collect()}
        assert got == {g: pytest.approx(plain_indices(x)[name]) for g, x in groups.items()}, name
    weighted = {r.g: r.value for r in diversity.calc_gini(df, "x", ["g"], "w").collect()}
    assert weighted == {g: pytest.approx(plain_indices(x, [float(i % 3 + 1) for i in range(len(x))])["gini"]) for g, x in groups.items()}
    assert diversity.pop_calcs(df, "other", "x") is None
    odd = spark.createDataFrame([(0.0,), (3.0,), (None,)], "x double")
    assert math.isnan(diversity.calc_shannon(odd, "x", []).first().value)
    assert diversity.calc_shannon(odd, "x", [], drop_zero=True).first().value == 0
    assert math.isnan(diversity.calc_clonality(spark.createDataFrame([(4.0,)], "x double"), "x", []).first().value)
    assert diversity.calc_uc50(odd, "x", []).first().value is None
    with pytest.raises(ValueError):
        diversity.calc_uc50(spark.createDataFrame([("a",)], "x string"), "x", [])


def test_vectors(spark):
    df = spark.createDataFrame([([1, 0, 1], [6, 7, 4])], "a array<int>, b array<int>")
    assert df.select(vectors.vzip("a", "b").alias("z")).first().z == [1, 6, 0, 7, 1, 4]
    with pytest.raises(Exception, match="differ in length"):
        df.select(vectors.vzip(F.col("a"), F.slice("b", 1, 2))).collect()
    sets = [spark.createDataFrame([(v,) for v in x], "v int") for x in ((1, 2, 3), (2, 3, 4), (3, 4, 5))]
    assert [r.value for r in vectors.vintersect(*sets).collect()] == ["3"]
    assert [r.value for r in vectors.vintersect(*sets, limit=2).collect()] == ["2", "3", "4"]
    with pytest.raises(ValueError):
        vectors.vintersect(*sets, limit=4)
    rows = spark.createDataFrame([("a b", 3, None)], "A string, B int, C string")
    assert rows.select(vectors.vcollapse(rows, sep="-", fill="z").alias("v")).first().v == "ab-3-z"
    with pytest.raises(Exception, match="vcollapse"):
        rows.select(vectors.vcollapse(rows)).collect()


def test_scoring_tables(spark):
    table = {f.__name__: {(r.ref, r.query): r.score for r in f(spark).collect()} for f in (scoring.banmat, scoring.ssanmat, scoring.asanmat)}
    assert all(len(t) == 225 for t in table.values())
    assert table["banmat"]["S", "B"] == 0 and table["banmat"]["A", "W"] == 1 and table["banmat"]["N", "C"] == 1
    assert table["ssanmat"]["S", "V"] == 0.67 and table["ssanmat"]["V", "S"] == 0.66 and table["ssanmat"]["S", "W"] == 0
    assert table["asanmat"]["S", "B"] == 1 and table["asanmat"]["B", "S"] == 0.67 and table["asanmat"]["V", "S"] == 0.66


def test_scan_format(spark):
    a = spark.createDataFrame([("c", 5, 9, "+", "x"), ("c", 5, 9, "+", "y"), ("c", 1, 9, "-", "x")], CORE + ", g string")
    b = spark.createDataFrame([("b", 2, 3, "+", "x")], CORE + ", g string")
    assert [tuple(r) for r in scan_format(a, b, "g").collect()] == [("b", 2, 1), ("c", 5, 0), ("c", 5, 0), ("c", 9, 0)]


def test_fastq(spark, tmp_path):
    reads = [(f"M0:{i} 1:N", "ACGT"[: i % 4 + 1], "IIII"[: i % 4 + 1]) for i in range(1, 9)]
    text = "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in reads)
    (tmp_path / "in.fastq").write_text(text)
    with gzip.open(tmp_path / "in2.fastq.gz", "wt") as f:
        f.write(text)
    for name in ("in.fastq", "in2.fastq.gz"):
        df = fastq.read_fastq(spark, str(tmp_path / name))
        assert [(r.read_index, r.id, r.seq) for r in df.orderBy("read_index").collect()] == [(i + 1, f"M0:{i + 1}", s) for i, (_, s, _) in enumerate(reads)]
    samples = spark.createDataFrame([(1, "A"), (3, "A"), (2, "B")], "index int, sampleName string")
    (tmp_path / "out").mkdir()
    for _ in range(2):
        made = fastq.write_demultiplexed(df, samples, str(tmp_path / "out"), "R1")
    assert [p.rsplit("/", 1)[1] for p in made] == ["A.R1.fastq.gz", "B.R1.fastq.gz"]
    with gzip.open(tmp_path / "out" / "A.R1.fastq.gz", "rt") as f:
        assert f.read() == "".join(f"@M0:{i}\n{reads[i - 1][1]}\n+\n{reads[i - 1][2]}\n" for i in (1, 3))
    plain = fastq.write_demultiplexed(df, samples, str(tmp_path / "out"), "R2", compress=False)
    assert plain[0].endswith("A.R2.fastq")


def test_generated_sites(spark):
    df = generate_sites(spark, 4, 30, positions=[100, 200, 300, 400])
    rows = df.collect()
    assert len(rows) == 120 and all(min(abs(r.start - c) for c in (100, 200, 300, 400)) < 8 and 30 <= r.end - r.start + 1 <= 100 for r in rows)
    assert len({r.end - r.start for r in rows}) <= 30


def test_stream_abundance(spark, tmp_path):
    rows = [("c", 1, 10, "+"), ("c", 1, 10, "+"), ("c", 1, 12, "+"), ("c", 7, 9, "+")]
    spark.createDataFrame(rows, CORE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CORE).parquet(str(tmp_path / "in"))
    run = stream_abundance(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.posid, r.estAbund) for r in spark.table("running").collect()} == {("c+1", 2), ("c+7", 1)}


def test_scan_clusters(spark):
    rng = random.Random(1)
    rows = [("c", i * 10, int(rng.random() < (0.95 if 100 <= i < 140 else 0.3))) for i in range(400)]
    points = spark.createDataFrame(rows, "chr string, pos long, grp int")
    out = scan_clusters(points, (15, 25)).filter("direction = 1").collect()
    assert len(out) == 1 and 800 <= out[0].start <= 1050 and 1350 <= out[0].end <= 1600
    assert scan_clusters(points.limit(0)).count() == 0
    assert binomial_limits(10, 0.5, 0.05) == (1, 9) and binomial_limits(3, 0.5, 0.05) == (-1, 4)
