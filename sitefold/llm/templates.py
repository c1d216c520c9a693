"""Line dedup by a log-template tree.

Lines go down a tree of fixed depth: the number of tokens, then the first three tokens, with
tokens that hold digits generalised to a variable field.  A leaf may hold several templates: at each position the tokens that
FREQUENT of the leaf's distinct lines share are constants, all others are variable fields; a line whose constants make up SIMILAR of its
tokens belongs to the template of these constants, any other one is a template of its own.  Lines of fewer than MIN_TOKENS tokens,
so all lines of unspaced scripts, are taken as they stand, digits and all.

A template recurs if MIN_DOCS distinct texts hold it: copies of a text count once.  Lines of recurring templates are dropped
everywhere but in the first text that holds them, and its copies, which are left to the near-duplicate stage.

Defined cases: null text has no lines and stays null; blank lines stay; repeated rows are one text here; the first text is that of the
least id, rows without an id coming first; a text may lose all lines and becomes empty; an empty table gives an empty result; texts of
any length are read whole; other columns pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import durable, let, small

DEPTH, MIN_TOKENS, MIN_DOCS, SIMILAR = 3, 3, 10, 0.7
#: The share, one in so many, of a leaf's distinct lines that makes a token a constant; so a position has that many at most.
FREQUENT = 5
FIELD = "<*>"
#: Tables of leaves are broadcast up to so many rows of 8 bytes, and recurring templates up to so many lines.
BROADCAST_LEAVES, BROADCAST_TEMPLATES = 1_000_000, 20_000


def _tokens(line: Column) -> Column:
    """A line's tokens, none for a blank line; in lines of enough tokens those with digits are generalised."""
    split = F.filter(F.split(F.btrim(line), r"\s+"), lambda x: x != "")
    return let(split, lambda k: F.when(F.size(k) < MIN_TOKENS, k).otherwise(F.transform(k, lambda x: F.when(x.rlike("[0-9]"), F.lit(FIELD)).otherwise(x))))


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), *[F.get(tokens, F.lit(i)) for i in range(DEPTH)])


def _lines(t: Column) -> Column:
    """i, leaf and tokens of each line that is not blank."""
    rows = F.transform(F.split(t, "\n"), lambda x, i: let(_tokens(x), lambda k: F.struct(i.alias("i"), _leaf(k).alias("leaf"), k.alias("tokens"))))
    return F.filter(rows, lambda x: F.size(x["tokens"]) > 0)


def _leaves(t: Column) -> Column:
    """The distinct leaves of a text's lines."""
    own = F.transform(F.split(t, "\n"), lambda x: let(_tokens(x), lambda k: F.when(F.size(k) > 0, _leaf(k))))
    return F.array_distinct(F.filter(own, lambda x: x.isNotNull()))


def _constants(lines: DataFrame) -> DataFrame:
    """leaf and, by position, its constant tokens: FREQUENT a position at most."""
    distinct = lines.select("leaf", "tokens").distinct()
    counts = distinct.select("leaf", F.posexplode("tokens").alias("p", "token")).groupBy("leaf", "p", "token").agg(F.count("*").alias("n"))
    sizes = distinct.groupBy("leaf").agg(F.count("*").alias("all"))
    # a token shared by one in FREQUENT lines is one of the FREQUENT most common ones of its place
    common = counts.filter("n > 1").join(sizes, "leaf").filter(FREQUENT * F.col("n") >= F.col("all"))
    by_place = common.groupBy("leaf", "p").agg(F.collect_list("token").alias("tokens"))
    return by_place.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("p", "tokens"))).alias("constants"))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """From (doc_id, key, t): doc_id, key, i and template of each line of a recurring template, and whether it is dropped."""
    leaves = docs.select("key", F.explode(_leaves(F.col("t"))).alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS).select("leaf")
    leaves = durable(leaves)
    seen = docs.select("doc_id", "key", F.explode(_lines(F.col("t"))).alias("x")).select("doc_id", "key", "x.*")
    seen = durable(seen.join(small(leaves, leaves.count(), BROADCAST_LEAVES), "leaf"))
    # written first, so that the lines of a hot leaf can be split in the join
    known = durable(_constants(seen))
    held = lambda x, p: F.coalesce(F.array_contains(F.element_at("constants", p), x), F.lit(False))
    made = F.transform("tokens", lambda x, p: F.when(held(x, p), x).otherwise(F.lit(FIELD)))
    constant = F.size(F.filter("tokens", lambda x, p: held(x, p)))
    general = F.coalesce(constant >= SIMILAR * F.size("tokens"), F.lit(False)) & (F.size("tokens") >= MIN_TOKENS)
    named = seen.join(known, "leaf", "left").withColumn("template", F.when(general, made).otherwise(F.col("tokens")))
    named = durable(named.select("doc_id", "key", "i", F.array_join("template", " ").alias("template")))
    texts = named.groupBy("template").agg(F.count_distinct("key").alias("texts"), F.min(F.struct("doc_id", "key")).alias("first"))
    kept = durable(texts.filter(F.col("texts") >= MIN_DOCS).select("template", "first"))
    out = named.join(small(kept, kept.count(), BROADCAST_TEMPLATES), "template")
    return out.select("doc_id", "key", "i", "template", (F.col("key") != F.col("first.key")).alias("dropped"))


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the input's row as a struct, its text without dropped lines), n_lines and n_dropped of every row."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("t"))
    marked = recurring_lines(slim).filter("dropped")
    gone = marked.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_set("i").alias("gone"))
    # the text travels once, within its row
    base = docs.select(row, F.xxhash64(F.col(text_col)).alias("key"))
    both = base.join(gone, F.col("row")[id_col].eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select("row", "gone")
    text = F.col("row")[text_col]
    rest = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i))
    cut = F.when(F.col("gone").isNull(), text).otherwise(let(F.split(text, "\n"), lambda x: F.array_join(rest(x), "\n")))
    count = F.coalesce(F.length(text) - F.length(F.translate(text, "\n", "")) + 1, F.lit(0)).cast("bigint")
    return both.select(
        F.col("row").withField(f"`{text_col}`", cut).alias("row"), count.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped")
    )
