"""The table of genomic intervals: core columns, checks and position expressions.

A table of sites has ``seqnames``, ``start``, ``end`` (1-based, closed) and ``strand`` (+, - or *) and any
further columns.  ``*`` is anchored like ``+``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORE = ("seqnames", "start", "end", "strand")


def require(df: DataFrame, *names: str) -> None:
    """Raises if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; present: {', '.join(df.columns)}")


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """``row`` (all columns as a struct) and the keys: whatever a table's columns are called, nothing clashes with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def five_prime() -> Column:
    """The range's 5' base, where integration took place."""
    return F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))


def three_prime() -> Column:
    """The range's 3' base, the break point."""
    return F.when(F.col("strand") == "-", F.col("start")).otherwise(F.col("end"))


def width() -> Column:
    return F.col("end") - F.col("start") + 1


def strand_rank(strand: Column) -> Column:
    """Strands sort as +, -, *."""
    return F.when(strand == "+", 0).when(strand == "-", 1).otherwise(2)


def metadata(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in CORE]


def stranded() -> Column:
    """The strand, raising on rows whose strand is not + or -."""
    return F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(F.raise_error(F.lit("sites must be on strand + or -")))


#: Bytes of a plan's own estimate (about 100,000 points, from compressed files) that one task should hold, and the same in rows.
TASK_BYTES, TASK_ROWS = 1 << 20, 100_000

#: Up to so many partitions the estimate is taken as it is; where it asks for more (joins are overestimated), rows are counted.
TRUSTED = 256


def tasks_for(df: DataFrame) -> int:
    """Partitions in proportion to the rows of ``df``, whatever the session's number: what a task holds does not grow with the table."""
    least = df.sparkSession.sparkContext.defaultParallelism
    wanted = -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES)
    if wanted > TRUSTED:
        wanted = -(-df.count() // TASK_ROWS)
    return max(least, wanted)
