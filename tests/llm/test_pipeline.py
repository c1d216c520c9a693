"""The pipeline's stages on a small corpus: each stage's decisions against brute force on its own input."""

import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.corpus import frame, item_frame, make


def test_stages(spark, tmp_path):
    docs, items = make(seed=3, size=80)
    docs = [x for x in docs if x[0] is not None]
    docs.append((900, "!!! ??? 123"))
    frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    item_frame(spark, items).select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = now.columns
    held = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        before = sorted(((r.doc_id, r.text) for r in now.collect()), key=repr)
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        if name == "encoding":
            break
        assert now.columns == names, name
        after = sorted(((r.doc_id, r.text) for r in now.collect()), key=repr)
        if name == "language_id":
            assert {d for d, t in before} - {d for d, t in after} == {d for d, t in before if not any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            cut = dict(brute.kept_lines(before))
            assert after == sorted(((d, cut[d]) for d, t in before if cut[d] == t or (cut[d] or "").strip(" ")), key=repr)
        elif name == "near_dedup":
            heads = [(d, t, n) for (d, t), (_, n, c) in zip(before, brute.near_duplicates(before, corpus_pipeline.SIMILAR), strict=True) if d == c]
            # rows that repeat an id and a text with words are copies too
            assert after == sorted([*{(d, t) for d, t, n in heads if n}, *[(d, t) for d, t, n in heads if not n]], key=repr)
        elif name == "decontamination":
            hit = {r[0] for r in brute.decontaminated(before, items) if r[-1]}
            assert hit and after == [(d, t) for d, t in before if d not in hit]
        held.append(len(after))
    assert held == sorted(held, reverse=True)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    texts = dict(before)
    for r in now.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, bytes(r.ids)) for r in whole.collect()) == sorted((r.doc_id, bytes(r.ids)) for r in now.collect())


def test_empty(spark, tmp_path):
    frame(spark, [(1, "x")]).select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    item_frame(spark, [(1, "a b")]).select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert random.Random(1).random() < 1
