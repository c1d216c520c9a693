"""Quality rules with host-level verdicts (DataFrame functions only).

Per document the rules count words, symbols, repeated lines and repeated 3-word windows.  Failures
of the soft rules are summed by host, each host's failure rate is shrunk towards the pool by a beta
prior fitted to all hosts (method of moments), and the verdict is joined back: a host breaks a rule habitually if its
shrunk rate lies above the pool's by SPREAD standard deviations of the prior.  A document that breaks a soft rule
severely goes by itself; one that breaks it mildly goes if its host breaks that rule habitually, and stays at other hosts.

Defined cases: null text has no words and fails; a null host is a host of its own; repeated rows
are judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import durable, let, small

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Soft rules: share of symbols among word characters; number and share of repeated lines.
MAX_SYMBOL_SHARE, MIN_DUP_LINES, MAX_DUP_LINE_SHARE = 0.10, 3, 0.30
#: A rule is broken severely beyond so many times its limits.
SEVERE = 2.0
#: How many of the prior's standard deviations a habitual host's shrunk rate lies above the pool's.
SPREAD = 0.5
#: Host tables of up to so many rows are broadcast; larger ones are shuffled.
BROADCAST_HOSTS = 100_000
#: Documents of fewer words have their windows sorted as packed integers.
PACKED_WORDS = 1 << 16


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII white spaces."""
    return let(
        F.btrim(text, F.lit(SPACE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[ \x09-\x0D]+")),
    )


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` that begin at the ascending ``starts``."""
    init = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("long").alias("last"))
    return F.aggregate(
        starts,
        init,
        lambda s, p: F.struct((s["n"] + F.least(F.lit(width).cast("long"), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )


def _same(w: Column, i: Column, j: Column) -> Column:
    at = lambda p, k: F.get(w, (p + k).cast("int"))
    return (at(i, 0) == at(j, 0)) & (at(i, 1) == at(j, 1)) & (at(i, 2) == at(j, 2))


def _repeat_starts(w: Column, hashes: Column) -> Column:
    """Ascending starts of the 3-word windows that occur more than once; equal hashes are confirmed on the words."""
    mask = PACKED_WORDS - 1
    packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))

    def kept(items: Column, key, pos) -> Column:
        def twin(x: Column, y: Column) -> Column:
            return F.coalesce((key(x) == key(y)) & _same(w, pos(x), pos(y)), F.lit(False))

        found = let(
            items,
            lambda a: F.filter(a, lambda x, i: twin(x, F.get(a, i - 1)) | twin(x, F.get(a, i + 1))),
        )
        return F.sort_array(F.transform(found, pos))

    return F.when(
        F.size(hashes) < PACKED_WORDS,
        kept(packed, lambda x: x.bitwiseAND(F.lit(~mask)), lambda x: x.bitwiseAND(F.lit(mask).cast("long"))),
    ).otherwise(kept(pairs, lambda x: x["h"], lambda x: x["i"]))


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more."""

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(_repeat_starts(w, h), 3))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The counts of each document: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col("t"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("t"))
    lines = F.transform(F.split(t, "\n"), lambda x: x)
    full = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return base.select(
        "doc_id",
        "host",
        let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("w"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(full, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"), F.size(x).alias("n"))).alias("l"),
    ).select(
        "doc_id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"),
    )


def with_failures(m: DataFrame) -> DataFrame:
    """Adds base_failed and, as 0 or 1, each soft rule's failure."""
    return m.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "bad_symbols": (F.col("n_symbols") > MAX_SYMBOL_SHARE * F.col("word_chars")).cast("int"),
            "bad_lines": ((F.col("n_dup_lines") >= MIN_DUP_LINES) & (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"))).cast("int"),
            "severe": (F.col("n_symbols") > SEVERE * MAX_SYMBOL_SHARE * F.col("word_chars"))
            | ((F.col("n_dup_lines") >= MIN_DUP_LINES) & (F.col("n_dup_lines") > SEVERE * MAX_DUP_LINE_SHARE * F.col("n_lines"))),
        }
    )


SOFT = ("bad_symbols", "bad_lines")


def host_rates(failures: DataFrame) -> DataFrame:
    """Per host: documents, failures, the shrunk rate of each soft rule and whether the host breaks it habitually.

    With rates of mean m and variance v over the hosts, the prior is beta(m s, (1 - m) s) where
    s = m (1 - m) / v - 1, held between 1 and 1000.
    """
    hosts = durable(failures.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(r).alias(r) for r in SOFT]))
    stats = hosts.agg(*[f(F.col(r) / F.col("n")).alias(f"{k}_{r}") for r in SOFT for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    out = hosts
    for r in SOFT:
        m, v = stats[f"m_{r}"] or 0.0, stats[f"v_{r}"] or 0.0
        s = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        out = out.withColumn(f"rate_{r}", (F.col(r) + m * s) / (F.col("n") + s))
        out = out.withColumn(f"habit_{r}", F.col(f"rate_{r}") > m + SPREAD * math.sqrt(m * (1 - m) / (s + 1)))
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Every document with its counts, ``base_failed``, the host's shrunk rates and ``kept``."""
    failures = durable(with_failures(measures(docs, id_col, text_col, host_col)))
    rates = host_rates(failures).select(F.col("host").alias("h"), *[f"{k}_{r}" for k in ("rate", "habit") for r in SOFT])
    joined = failures.join(small(rates, rates.count(), BROADCAST_HOSTS), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    habitual = F.lit(False)
    for r in SOFT:
        habitual = habitual | ((F.col(r) == 1) & F.col(f"habit_{r}"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("severe") & ~habitual)
