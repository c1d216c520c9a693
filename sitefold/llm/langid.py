"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a binary classifier over hashed 3-byte n-grams predicts
from a text's mean log-odds whether its language has that bit.  Decoding adds up, for each codeword,
the bits' logistic losses weighted by the classifiers' accuracy, and takes the nearest one.  Texts
whose two nearest codewords are hardly apart are flagged as ambiguous.

The n-gram counts come from a sample of labelled rows, about SAMPLE for each language (all rows of rarer
ones), chosen by a hash of id and text; it is the only bounded part.  A model is one vector per language.

Defined cases: null or letterless text gives ``und`` with score 0; without any labelled row all texts give
``und``; a null id is never held out and never learnt from; repeated rows are judged each; an empty
table gives an empty result; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefold.llm.common import durable, shipped

#: Labelled rows per language that are sampled for training.
SAMPLE = 4000
#: Hashed n-grams, and the longest codeword.
CELLS, BITS = 1 << 15, 31
#: From this ratio of the second codeword's share to the nearest one's on a text is called ambiguous.
AMBIGUOUS = 0.5
CHUNK = 1 << 19
LETTER = regex.compile(r"\p{L}")
#: Letters and bytes beyond ASCII stand for themselves, all else for a blank.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def codewords(n: int) -> np.ndarray:
    """n words of bits, far apart: all splits of the languages where they are few, else seeded random ones."""
    if n <= 5:
        rest = [c for c in itertools.product((0, 1), repeat=max(n - 1, 1)) if any(c)]
        return np.array([(0, *c) for c in rest], np.int8).T[:n] if n > 1 else np.zeros((1, 1), np.int8)
    rng = np.random.default_rng(11)
    best, apart = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, BITS), dtype=np.int8)
        mixed = (code.sum(0) > 0) & (code.sum(0) < n)
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if mixed.all() and least > apart:
            best, apart = code, least
    return best if best is not None else code


def grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: first index, hashed 3-grams, and where each text's begin (a text has at least one)."""
    at = 0
    while at < len(texts):
        to, size, parts = at, 0, []
        while to < len(texts) and (to == at or size < CHUNK):
            raw = (" " + texts[to].lower() + "  ").encode()
            parts.append(raw)
            size += len(raw)
            to += 1
        data = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
        code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        yield at, ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32), starts
        at = to


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The mean log-odds of each text for each bit."""
    out = np.zeros((len(texts), len(weights)))
    for at, cells, starts in grams(texts):
        sizes = np.diff([*starts, len(cells)])
        for b, w in enumerate(weights):
            out[at : at + len(starts), b] = np.add.reduceat(w[cells].astype(np.float64), starts) / sizes
    return out


class Model:
    """Languages, codewords, log-odds per bit and n-gram, and each bit's weight."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        share = np.array([(counts[x] + 0.1) / (counts[x].sum() + 0.1 * CELLS) for x in self.langs])
        ones = [share[self.code[:, b] == 1].mean(0) if self.code[:, b].any() else share.mean(0) for b in range(self.code.shape[1])]
        zeros = [share[self.code[:, b] == 0].mean(0) if (self.code[:, b] == 0).any() else share.mean(0) for b in range(self.code.shape[1])]
        self.weights = np.log(np.array(ones) / np.array(zeros)).astype(np.float32)
        self.trust = np.ones(len(self.weights))

    def learn_trust(self, right: np.ndarray, total: int) -> None:
        """Weights the bits by their training accuracy beyond chance."""
        self.trust = np.maximum(right / max(total, 1) - 0.5, 0.01) * 2

    def decode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword, its share of the weight and the second one's share over it; losses are logistic in 12 times the mean log-odds."""
        signs = 2.0 * self.code - 1
        loss = np.logaddexp(0, -12 * signs[None] * m[:, None, :]) @ self.trust
        gap = np.exp(loss.min(1, keepdims=True) - loss)
        second = np.sort(gap, 1)[:, -2] if gap.shape[1] > 1 else np.zeros(len(gap))
        return loss.argmin(1), 1 / gap.sum(1), second


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model | None:
    """Learns from the text and language of labelled rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("y"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, sample / n))) for y, n in sorted(sizes.items())])
    draw = F.pmod(F.xxhash64("id", "t"), F.lit(1 << 30)) / float(1 << 30)
    # the sample is bounded, so that few tasks can count it
    some = durable(rows.filter(draw < share).select("y", "t").repartition(8))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for _, cells, _ in grams([t]):
                    sums[y] = sums.get(y, 0) + np.bincount(cells, minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["y", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for y, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[y] = sums.get(y, 0) + np.frombuffer(v, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["y", "v"])

    # at most eight vectors a language are added up on the executors; the driver gets one
    vectors = some.mapInArrow(counted, "y string, v binary").repartition("y").mapInArrow(added, "y string, v binary")
    counts = {r["y"]: np.frombuffer(r["v"], "<i8") for r in vectors.collect()}
    model = Model(counts)

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, total = np.zeros(len(model.weights), np.int64), 0
        for batch in batches:
            rows_ = [model.langs.index(y) for y in batch.column(0).to_pylist()]
            m = margins(batch.column(1).to_pylist(), model.weights)
            right += ((m > 0) == (model.code[rows_] == 1)).sum(0) if rows_ else 0
            total += len(rows_)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([right.tolist()], pa.list_(pa.int64()))], ["n", "right"])

    votes = some.mapInArrow(tested, "n bigint, right array<bigint>").collect()
    model.learn_trust(sum((np.array(r["right"]) for r in votes), np.zeros(len(model.weights))), sum(r["n"] for r in votes))
    return model


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``row`` (the input's row as a struct), doc_id, lang_pred, score and ambiguous of every row."""
    shipped(docs.sparkSession)
    model = fit(docs, id_col, text_col, lang_col)
    base = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    doc_id, text = docs.columns.index(id_col), docs.columns.index(text_col)
    if model is None:
        return base.select("row", F.col("row")[id_col].alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            fields = batch.column(0).flatten()
            texts = [t or "" for t in fields[text].to_pylist()]
            best, score, second = known.decode(margins(texts, known.weights)) if texts else ([], [], [])
            worded = [bool(LETTER.search(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    fields[doc_id],
                    pa.array([known.langs[k] if w else "und" for k, w in zip(best, worded, strict=True)], pa.string()),
                    pa.array([float(s) if w else 0.0 for s, w in zip(score, worded, strict=True)], pa.float64()),
                    pa.array([not w or float(s) >= AMBIGUOUS for s, w in zip(second, worded, strict=True)], pa.bool_()),
                ],
                ["row", "doc_id", "lang_pred", "score", "ambiguous"],
            )

    schema = T.StructType(
        [base.schema["row"], T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    )
    return base.mapInArrow(run, schema)
