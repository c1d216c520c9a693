"""The pipeline's line dedup counts recurrence over distinct texts."""

import random

import corpus_pipeline
from sitefold.llm import templates
from tests.llm.corpus import frame, words


def rest(spark, docs):
    return {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame(spark, docs), "").collect()}


def test_blocks_and_skew(spark):
    """A header of several lines, and a line of 100 documents that a large copy group holds too, go everywhere but once."""
    rng = random.Random(7)
    header = [" ".join(words(rng, 8)) for _ in range(3)]
    body = [" ".join(words(rng, 20)) for _ in range(160)]
    docs = [(i, "\n".join([*header, body[i]])) for i in range(30)]
    line = " ".join(words(rng, 9))
    docs += [(100 + i, "\n".join([body[30 + i], line, body[31 + i]])) for i in range(100)]
    docs += [(1000 + i, "\n".join([body[140], line, body[141]])) for i in range(400)]
    out = rest(spark, docs)
    assert len(out) == len(docs)
    assert out[0] == docs[0][1] and all(out[i] == body[i] for i in range(1, 30))
    assert line in out[100] and all(line not in out[i] for i in [*range(101, 200), *range(1000, 1400)])


def test_copies_stay_whole(spark):
    """Copies of the first text keep its lines; copies alone are no recurrence."""
    rng = random.Random(8)
    line, body = " ".join(words(rng, 9)), [" ".join(words(rng, 20)) for _ in range(20)]
    docs = [(i, f"{body[0]}\n{line}") for i in range(5)] + [(10 + i, f"{body[i + 1]}\n{line}") for i in range(15)]
    out = rest(spark, docs)
    assert all(out[i] == docs[0][1] for i in range(5)) and all(out[10 + i] == body[i + 1] for i in range(15))
    alone = [(i, f"{body[0]}\n{line}") for i in range(40)]
    assert templates.drop_templates(frame(spark, alone)).filter("n_dropped > 0").count() == 0


def test_short_and_unspaced_lines(spark):
    """Short lines and lines of an unspaced script recur from 10 texts on; digits tell them apart."""
    rng = random.Random(9)
    body = [" ".join(words(rng, 20)) for _ in range(40)]
    chinese = "版权所有未经许可不得转载2024年" * 20
    docs = [(i, f"{body[i]}\nLes.\n{chinese}") for i in range(12)]
    docs += [(20 + i, f"{body[20 + i]}\nrare") for i in range(9)]
    docs += [(30 + i, f"{body[30 + i]}\n{700 + i}") for i in range(10)]
    out = rest(spark, docs)
    assert out[0] == docs[0][1] and all(out[i] == body[i] for i in range(1, 12))
    assert all(out[d] == t for d, t in docs[12:])
