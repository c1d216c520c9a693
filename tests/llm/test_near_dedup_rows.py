"""The pipeline decides near-duplicates by id and text."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.corpus import frame, item_frame, words


def test_null_and_repeated_ids(spark):
    rng = random.Random(12)
    a, b, c, d, e, f = (" ".join(words(rng, 60)) for _ in range(6))
    near = c + " end"
    docs = [(1, a), (None, a), (None, b), (None, c), (None, c), (None, near), (2, d), (7, d), (7, e), (None, None), (None, ""), (None, ""), (8, f), (8, f), (8, f), (9, "!")]
    table = frame(spark, docs).withColumns({"other": F.lit("o"), "mark": F.lit("m"), "extra": F.lit(1), "d": F.lit("d"), "side": F.lit(0)})
    kept = corpus_pipeline.near_dedup(spark, table, "")
    assert kept.columns == table.columns
    out = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    heads = [t for i, t in out if i is None and t in (c, near)]
    assert len(heads) == 1
    assert out == sorted([(1, a), (None, b), (None, heads[0]), (2, d), (7, e), (None, None), (None, ""), (None, ""), (8, f), (9, "!")], key=repr)


def test_decontamination_of_clashing_names(spark, tmp_path):
    words_ = " ".join(words(random.Random(1), 12))
    item_frame(spark, [(1, words_)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, f"x {words_} y"), (1, "clean"), (None, words_), (None, "clean too"), (None, None)]
    table = frame(spark, docs).withColumns({"other": F.lit("o"), "mark": F.lit("m"), "item": F.lit(1)})
    out = corpus_pipeline.decontamination(spark, table, str(tmp_path))
    assert out.columns == table.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "clean"), (None, "clean too"), (None, None)], key=repr)
