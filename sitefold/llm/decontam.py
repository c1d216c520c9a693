"""Benchmark decontamination by winnowing (DataFrame functions only).

Both sides keep, of every 10-word window, the least 5-gram hash, so each shared span of 10 words
has a fingerprint in common.  Documents' fingerprints carry the words around them; those that meet
a benchmark fingerprint are extended to the windows that hold them, which are confirmed word for
word against the benchmark's windows.  Items shorter than a window are one window each, and their
whole length is their fingerprint.

Defined cases: null or word-less texts have no windows, and no hit; null item ids read as the
empty string, rows that share an item id are one item; repeated documents give a row each; an
empty table on either side gives no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import durable, let

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Benchmark tables are broadcast up to so many rows of fingerprints and windows; beyond, both joins shuffle.
BROADCAST_ROWS = 400_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _gram(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)])


def _upto(n: Column) -> Column:
    """0 .. n-1, empty where n is less than 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _winnowed(w: Column, make) -> Column:
    """``make(position, hash)`` for each 5-gram that is least in some 10-word window (all ties count)."""

    def picked(g: Column) -> Column:
        least = F.transform(_upto(F.size(g) - (SPAN - 1)), lambda i: F.least(*[F.get(g, i + k) for k in range(SPAN)]))
        return let(
            least,
            lambda m: F.filter(
                F.transform(
                    g,
                    lambda h, j: F.when(F.greatest(*[F.get(m, j - k) for k in range(SPAN)]) == h, make(j, h)),
                ),
                lambda x: x.isNotNull(),
            ),
        )

    return let(F.transform(_upto(F.size(w) - (GRAM - 1)), lambda i: _gram(w, i, GRAM)), picked)


def _context(w: Column, j: Column) -> Column:
    first = F.greatest(F.lit(0), j - (SPAN - 1))
    return F.slice(w, first + 1, F.least(F.size(w), j + WINDOW) - first)


def _join(words: Column) -> Column:
    return F.array_join(words, " ")


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each distinct window of the benchmark with the items that hold it."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w"))
    windows = F.when(F.size("w").between(1, WINDOW - 1), F.array(_join(F.col("w")))).otherwise(
        F.transform(_upto(F.size("w") - (WINDOW - 1)), lambda i: _join(F.slice("w", i + 1, WINDOW)))
    )
    return words.select("item", F.explode(windows).alias("win")).groupBy("win").agg(F.collect_set("item").alias("items"))


def benchmark_fingerprints(items: DataFrame, text_col: str) -> DataFrame:
    """Distinct fingerprints h, with the number of words that they cover."""
    words = items.select(words_of(F.col(text_col)).alias("w"))
    short = F.array(*[F.when(F.size("w") == n, F.struct(_gram(F.col("w"), F.lit(0), n).alias("h"), F.lit(n).alias("n"))) for n in range(1, WINDOW)])
    found = F.when(F.size("w") < WINDOW, short).otherwise(
        _winnowed(F.col("w"), lambda j, h: F.struct(h.alias("h"), F.lit(WINDOW).alias("n")))
    )
    return words.select(F.explode(found).alias("f")).filter("f is not null").select("f.h", "f.n").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (start and length of matched windows), n_hit, the items met and contaminated."""
    prints = durable(benchmark_fingerprints(items, item_text))
    windows = durable(benchmark_windows(items, item_col, item_text))
    lengths = sorted(r["n"] for r in prints.select("n").distinct().collect())  # at most ten numbers
    near = prints.count() + windows.count() <= BROADCAST_ROWS
    side = F.broadcast if near else (lambda df: df)

    row = lambda h, j, n, ctx: F.struct(h.alias("h"), j.cast("int").alias("j"), F.lit(n).alias("n"), ctx.alias("ctx"))

    def short_rows(w: Column, n: int) -> Column:
        return F.transform(_upto(F.size(w) - (n - 1)), lambda j: row(_gram(w, j, n), j, n, F.slice(w, j + 1, n)))

    def rows(w: Column) -> Column:
        marker = row(F.lit(None).cast("bigint"), F.lit(-1), 0, F.lit(None).cast("array<string>"))
        parts = [F.array(marker)]
        for n in lengths:
            if n == WINDOW:
                parts.append(_winnowed(w, lambda j, h: row(h, j, WINDOW, _context(w, j))))
            else:
                parts.append(short_rows(w, n))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.concat(*parts).alias("rows"))

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    cut = base.select("doc_id", F.xxhash64("t").alias("key"), let(words_of(F.col("t")), rows).alias("x"))
    spread = cut.select("doc_id", "key", F.col("x.n_words").alias("n_words"), F.explode("x.rows").alias("f")).select("doc_id", "key", "n_words", "f.*")
    marks = F.col("h").isNull()
    met = spread.join(side(prints.select(F.col("h").alias("bh"), F.lit(True).alias("met")).distinct()), F.col("h") == F.col("bh"), "left")
    met = met.filter(marks | F.col("met"))
    first = F.greatest(F.lit(0), F.col("j") - (SPAN - 1))
    starts = F.when(marks, F.array(F.lit(-1))).when(F.col("n") < WINDOW, F.array("j")).otherwise(
        F.sequence(first, F.least(F.col("j"), (F.col("n_words") - WINDOW).cast("int")))
    )
    base_at = F.when(F.col("n") < WINDOW, F.col("j")).otherwise(first)
    spans = met.select("doc_id", "key", "n_words", "n", "ctx", base_at.alias("at"), F.explode(starts).alias("start"))
    spans = spans.withColumn("w", F.when(F.col("ctx").isNotNull(), _join(F.slice("ctx", F.col("start") - F.col("at") + 1, F.col("n"))))).drop("ctx", "at")
    hits = spans.join(side(windows), F.col("w") == F.col("win"), "left").filter((F.col("start") < 0) | F.col("win").isNotNull())
    found = hits.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("start") < 0, 1)).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("start") >= 0, F.struct("start", "n")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    init = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        "spans",
        init,
        lambda s, x: F.struct(
            (s["c"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(s["upto"], x["start"]))).alias("c"),
            F.greatest(s["upto"], x["start"] + x["n"]).alias("upto"),
        ),
        lambda s: s["c"],
    )
    one = found.select("*", covered.alias("n_hit"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return one.select("doc_id", "key", "n_words", "spans", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))
