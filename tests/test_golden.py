"""The published expectations of each operator."""

import pytest
from pyspark.sql import functions as F

from sitefold.functions.ids import generate_posid
from sitefold.operators.abundance import condense_intsites, determine_abundance
from sitefold.operators.components import cluster_kv
from sitefold.operators.standardize import refine_breakpoints, standardize_sites
from sitefold.operators.unique import unique_granges
from sitefold.sources.dbrows import db_to_sites
from tests import golden as G


def test_standardize_sites(spark):
    rows = standardize_sites(G.f1(spark)).orderBy("row_id").collect()
    assert [r.start for r in rows] == G.F1_SITES
    assert [r.end for r in rows] == [s + w - 1 for s, w in zip(G.F1_START, G.F1_WIDTH, strict=True)]


def test_refine_breakpoints(spark):
    rows = refine_breakpoints(G.f2(spark)).orderBy("row_id").collect()
    assert [r.end if r.strand == "+" else r.start for r in rows] == G.F2_BREAKS


def test_determine_abundance(spark):
    rows = {int(r.posid[5:]): r for r in determine_abundance(G.f1(spark)).collect()}
    assert {p: (r.estAbund, r.relRank) for p, r in rows.items()} == G.F1_ABUNDANCE
    assert all(r.group == "group1" and r.relAbund == pytest.approx(r.estAbund / 99) for r in rows.values())


def test_condense_intsites(spark):
    out = condense_intsites(G.f1(spark), return_abundance=True)
    assert out.columns[-4:] == ["estAbund", "relAbund", "relRank", "posid"]
    rows = out.collect()
    assert {r.start: (r.estAbund, r.relRank) for r in rows} == G.F1_ABUNDANCE
    assert all(r.start == r.end and r.posid == f"chr1+{r.start}" for r in rows)


def test_unique_granges(spark):
    starts = [598] * 2 + [599] * 6 + [600] * 12
    ends = [687] * 8 + [660] * 2 + [640] * 10
    rows = [("chr1", s, e, "+" if i < 10 else "-", "AB"[i % 2], 1.0) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]
    df = spark.createDataFrame(rows, "seqnames string, start long, end long, strand string, sample string, counts double")
    out = unique_granges(df, sum_cols=["counts"]).orderBy("start", "end", "sample").collect()
    assert [tuple(r)[1:] for r in out] == [
        (598, 687, "+", "A", 1), (598, 687, "+", "B", 1), (599, 687, "+", "A", 3), (599, 687, "+", "B", 3),
        (600, 640, "-", "A", 5), (600, 640, "-", "B", 5), (600, 660, "+", "A", 1), (600, 660, "+", "B", 1),
    ]


def test_db_rows(spark):
    rows = [
        ("chr1", 5379927.0, 5380070.0, "+", "GTSP0001-3", False), ("chr2", 92775920.0, 92775995.0, "+", "GTSP0003-1", True),
        ("chr2", 2719573.0, 2719450.0, "-", "GTSP0002-4", False), ("chr3", 7195924.0, 7195890.0, "-", "GTSP0003-1", True),
    ]
    df = spark.createDataFrame(rows, "chr string, position double, breakpoint double, strand string, sampleName string, `is.multihit` boolean")
    out = db_to_sites(df)
    assert out.columns == ["seqnames", "start", "end", "strand", "samplename", "specimen", "is.multihit"]
    assert [tuple(r)[1:3] + (r.specimen,) for r in out.collect()] == [
        (5379927, 5380070, "GTSP0001"), (92775920, 92775995, "GTSP0003"), (2719450, 2719573, "GTSP0002"), (7195890, 7195924, "GTSP0003"),
    ]
    moved = db_to_sites(df.withColumn("length", F.lit(10.0)), keep_additional_columns=False, split_sample_name=False)
    assert [tuple(r)[1:3] for r in moved.collect()][2] == (2719563, 2719573)
    twice = df.select("*", F.lit("x").alias("sampleName"))
    assert db_to_sites(twice).first().samplename == "GTSP0001-3"


def test_posid(spark):
    rows = [("chr1", "+", 900231, 900431), ("chr3", "-", 13254892, 13255292), ("chrX", "+", 603292, 603592)]
    df = spark.createDataFrame(rows, "seqnames string, strand string, start long, end long")
    assert [r.posid for r in generate_posid(df).collect()] == ["chr1+900231", "chr3-13255292", "chrX+603292"]
    assert generate_posid(df, "_").first().posid == "chr1_+_900231"


def test_cluster_kv(spark):
    pairs = spark.createDataFrame([(k, float(v)) for k, vs in {"A": (1, 2, 3), "B": (3, 4, 5), "C": (6, 7, 8)}.items() for v in vs], "key string, val double")
    assert {r.key: r.clus for r in cluster_kv(pairs, returns="simple").collect()} == {"A": 1, "B": 1, "C": 2}
    assert cluster_kv(pairs).count() == 9
    assert [tuple(r) for r in cluster_kv(pairs, returns="graph").collect()] == [("B", "A")]
    with pytest.raises(ValueError):
        cluster_kv(pairs, returns="other")
