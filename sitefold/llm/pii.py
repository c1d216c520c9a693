"""Personal data by weak supervision (DataFrame functions only).

Patterns propose spans; regex, gazetteer and context labelers vote on each; expectation-maximisation
over the counted vote patterns estimates how reliable each labeler is; a logistic span classifier
is fitted to the resulting posteriors and decides on the spans that the exact base rules leave out.
Base spans always stay.

The classifier sees the votes and the span itself (length, digits, letters, the mark before it), so it can tell spans apart that
have the same votes.  Only the table of patterns of votes and features (a fixed number at most, whatever the input) reaches the driver.
Contexts reach back to the last match of the same pattern, 30 characters at most.

Defined cases: null text reads as empty and has no spans; repeated rows give a row each; an empty
table gives an empty result; very long texts are matched whole, in linear time (possessive
patterns anchored to the starts of runs); other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.llm.common import durable, let

#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Name, kind, whether it is a base rule, what a text must hold, pattern.
PATTERNS = (
    ("email", "email", True, "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", True, ".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"),
    ("card", "card", True, None, r"[0-9](?:[ -]?[0-9])++"),
    ("phone", "phone", True, "+", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("hidden", "email", False, "at", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++"),
    ("local", "phone", False, None, r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("secret", "secret", False, None, r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+"),
)
#: Words before a span that speak for its kind, and words that speak against any.
FOR = {
    "email": "mail|contact|write",
    "ip": "host|server|addr|ip",
    "card": "card|visa|credit|payment|amex",
    "phone": "phone|tel|call|fax|mobile",
    "secret": "token|passw|secret|key|auth|akia",
}
AGAINST = "isbn|version|order|invoice|serial|sku"
#: Fixed values, gazetteers: endings of mail domains, first digits of card numbers, country calling codes, first characters of
#: well-known keys, and address ranges that are reserved.
GAZETTEERS = {
    "email": r"[.\])\x20](?i:com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|us|uk|de|fr|es|it|nl|be|ch|at|pl|se|no|dk|fi|pt|ie|cz|ru|ua|gr|tr|cn|jp|kr|in|au|nz|ca|br|mx|ar|cl|za|il|eu)$",
    "ip": r"^(?:10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|36|38|35|6011|65|64[4-9]|62)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[1-9]|37[0-9]|38[0-9]|42[013]|85[2356]|88[06]|96[0-8]|97[1-7])",
    "secret": r"^(?:AKIA|ASIA|ghp|gho|glpat|xox|sk|pk|rk|AIza|eyJ)",
}
LABELERS = ("rule", "words_for", "words_against", "edges", "prefix", "shape", "listed")
#: What the classifier sees of a span itself besides the votes: its length, its share of digits, whether it has capitals and small letters, whether it follows a mark.
FEATURES = ("long_", "digits_", "mixed", "marked")
BACK = 30


def _luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    value = lambda c: F.ascii(c) - 48
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    terms = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).when(i % 2 == 1, twice(value(c))).otherwise(value(c)))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(m: Column) -> Column:
    fits = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(999)) <= 255))
    return F.forall(F.split(m, r"\."), fits)


FOUND = "array<struct<pattern:string,i:int,gap:int,m:string,left:string,right:string>>"


def _matches(t: Column, name: str, need: str | None, pattern: str) -> Column:
    """A pattern's matches with the length of the gap before each and the text around it."""

    def made(ms: Column, gaps: Column) -> Column:
        return F.transform(
            ms,
            lambda m, i: F.struct(
                F.lit(name).alias("pattern"),
                i.alias("i"),
                F.length(F.get(gaps, i)).alias("gap"),
                m.alias("m"),
                F.lower(F.right(F.get(gaps, i), F.lit(BACK))).alias("left"),
                F.left(F.get(gaps, i + 1), F.lit(2)).alias("right"),
            ),
        )

    none = F.array().cast(FOUND)
    gaps, hits = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    located = let(hits, lambda ms: F.when(F.size(ms) > 0, let(gaps, lambda g: made(ms, g))).otherwise(none))
    return F.when(F.contains(t, F.lit(need)) if need else t.rlike("[0-9]"), located).otherwise(none)


def _proposals(t: Column) -> Column:
    return F.concat(*[_matches(t, name, need, pattern) for name, _, _, need, pattern in PATTERNS])


def _votes() -> dict[str, Column]:
    """1 for, -1 against, 0 no opinion, for each labeler."""
    kind, m, left, right = (F.col(c) for c in ("kind", "m", "left", "right"))
    plain = F.col("digits")
    count = F.length(plain)
    by_kind = lambda values: F.coalesce(*[F.when(kind == k, v) for k, v in values.items()], F.lit(0))
    sign = lambda c: F.when(c, 1).otherwise(-1)
    maybe = lambda c: F.when(c, 1).otherwise(0)
    return {
        "rule": F.when(F.col("base_pattern"), sign(F.col("base"))).otherwise(0),
        "words_for": by_kind({k: maybe(left.rlike(v)) for k, v in FOR.items()}),
        "words_against": F.when(left.rlike(AGAINST), -1).otherwise(0),
        "edges": sign(~left.rlike("[a-z0-9_]$") & ~right.rlike("^([A-Za-z0-9_]|[.-][0-9])")),
        "prefix": by_kind(
            {
                "email": sign(m.rlike(r"[.\])\x20][A-Za-z]{2,}$")),
                "ip": sign(~m.rlike("^0")),
                "card": sign(m.rlike("^[3-6]")),
                "phone": maybe(m.rlike(r"^[+(]")),
                "secret": sign(m.rlike("^AKIA") | (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 4)),
            }
        ),
        "shape": by_kind(
            {
                "email": maybe(F.length(m) <= 64),
                "ip": maybe(F.length(m).between(7, 15)),
                "card": sign(count.between(13, 19)),
                "phone": sign(count.between(9, 15)),
                "secret": maybe(F.length(m).isin(18, 20, 24, 32, 40, 64)),
            }
        ),
        "listed": by_kind({k: maybe(m.rlike(v)) for k, v in GAZETTEERS.items()}),
    }


def _span_features() -> dict[str, Column]:
    m, count = F.col("m"), F.length("digits")
    return {
        "long_": F.when(F.length(m) < 16, 0).when(F.length(m) < 32, 1).otherwise(2),
        "digits_": F.when(4 * count < F.length(m), 0).when(2 * count < F.length(m), 1).otherwise(2),
        "mixed": (m.rlike("[A-Z]") & m.rlike("[a-z]")).cast("int"),
        "marked": F.col("left").rlike(r"[:=#(\x22'] ?$").cast("int"),
    }


def reliabilities(patterns: list[dict], rounds: int = 60) -> tuple[list[float], dict]:
    """Expectation-maximisation over vote patterns with counts: posterior of each, and P(vote | true or not) by labeler.

    Starts from the sum of votes; counts are smoothed by one.
    """
    post = [1 / (1 + math.exp(-2 * sum(p[j] for j in LABELERS))) for p in patterns]
    rates: dict = {}
    for _ in range(rounds):
        prior = {}
        for k in KINDS:
            own = [(p["n"], q) for p, q in zip(patterns, post, strict=True) if p["kind"] == k]
            prior[k] = (sum(n * q for n, q in own) + 1) / (sum(n for n, _ in own) + 2)
        for j in LABELERS:
            table = {(v, y): 1.0 for v in (-1, 0, 1) for y in (0, 1)}
            for p, q in zip(patterns, post, strict=True):
                table[p[j], 1] += p["n"] * q
                table[p[j], 0] += p["n"] * (1 - q)
            for y in (0, 1):
                total = sum(table[v, y] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    rates[j, v, y] = table[v, y] / total
        for i, p in enumerate(patterns):
            odds = math.log(prior[p["kind"]] / (1 - prior[p["kind"]])) + sum(math.log(rates[j, p[j], 1] / rates[j, p[j], 0]) for j in LABELERS)
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, rates


#: Cells of the classifier: (column, value).
CELLS = (*[("kind", k) for k in KINDS], *[(j, v) for j in LABELERS for v in (1, -1)], *[(f, v) for f in FEATURES for v in (1, 2)])


def _features(p: dict) -> list[float]:
    return [1.0, *[float(p.get(c) == v) for c, v in CELLS]]


def classifier(patterns: list[dict], post: list[float], steps: int = 400) -> list[float]:
    """Logistic regression on the posteriors, weighted by the logarithm of the counts; a small table on the driver."""
    x = np.array([_features(p) for p in patterns]).reshape(len(patterns), 1 + len(CELLS))
    n = np.log1p([p["n"] for p in patterns])
    share, weights = n / (n.sum() or 1.0), np.zeros(1 + len(CELLS))
    for _ in range(steps):
        gap = share * (1 / (1 + np.exp(-(x @ weights))) - np.array(post))
        weights = weights - 2.0 * (gap @ x + 0.002 * weights)
    return weights.tolist()


def _score(weights: list[float]) -> Column:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return sum((one(F.col(c) == v) * w for (c, v), w in zip(CELLS, weights[1:], strict=True)), F.lit(weights[0]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: key, base (array of kind:start:end), spans (all, likewise) and a count for each base kind."""
    t = F.coalesce(F.col("t"), F.lit(""))
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).select(
        "doc_id", F.xxhash64("t").alias("key"), F.monotonically_increasing_id().alias("row"), let(t, _proposals).alias("found")
    )
    # the copy number `row` only tells repeated rows apart: rows are dealt by (doc_id, key)
    spread = raw.select("doc_id", "key", "row", F.explode_outer("found").alias("f")).select("doc_id", "key", "row", "f.*").repartition("doc_id", "key")
    run = Window.partitionBy("doc_id", "key", "row", "pattern").orderBy("i")
    kinds = F.coalesce(*[F.when(F.col("pattern") == n, F.lit(k)) for n, k, *_ in PATTERNS])
    placed = spread.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(run).cast("long")).withColumns(
        {
            "kind": kinds,
            "start": F.col("end") - F.length("m"),
            "digits": F.regexp_replace("m", "[^0-9]", ""),
            "base_pattern": F.col("pattern").isin([n for n, _, b, *_ in PATTERNS if b]),
        }
    )
    passes = (
        F.when(F.col("pattern") == "email", True)
        .when(F.col("pattern") == "ip", _octets(F.col("m")))
        .when(F.col("pattern") == "card", F.when(F.length("digits").between(13, 19), _luhn(F.col("digits"))).otherwise(False))
        .when(F.col("pattern") == "phone", F.length("digits").between(9, 15))
        .otherwise(False)
    )
    voted = durable(placed.withColumn("base", passes).withColumns(_votes() | _span_features()).drop("gap", "i", "left", "right", "digits", "m"))
    counted = [r.asDict() for r in voted.filter("pattern is not null").groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n")).orderBy("kind", *LABELERS, *FEATURES).collect()]
    post, _ = reliabilities(counted)
    score = _score(classifier(counted, post))
    # a further span must win the vote and be clear of every base span of its text
    order = Window.partitionBy("doc_id", "key", "row").orderBy("start", "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.lit(1 << 40)) >= F.col("end"))
    judged = voted.withColumn("added", ~F.col("base") & (score > 0) & clear)
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    item = F.struct(rank.alias("rank"), "start", "end", "kind")
    return (
        judged.groupBy("doc_id", "key", "row")
        .agg(
            *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS[:4]],
            F.sort_array(F.collect_list(F.when(F.col("base"), item))).alias("base"),
            F.sort_array(F.collect_set(F.when(F.col("base") | F.col("added"), item))).alias("spans"),
        )
        .drop("key", "row")
    )


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
