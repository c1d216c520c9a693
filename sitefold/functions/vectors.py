"""Vector utilities over array and table columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vzip(*arrays: Column | str) -> Column:
    """The arrays' elements in turn; raises where their lengths differ."""
    cols = [F.col(a) if isinstance(a, str) else a for a in arrays]
    same = reduce(lambda x, y: x & y, [F.size(c) == F.size(cols[0]) for c in cols])
    names = [f"v{i}" for i in range(len(cols))]
    zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(cols, names, strict=True)])
    turns = F.flatten(F.transform(zipped, lambda z: F.array(*[z.getField(n) for n in names])))
    return F.when(same, turns).otherwise(F.raise_error(F.lit("vzip: arrays differ in length")))


def vintersect(*sets: DataFrame, limit: int | None = None, name: str = "value") -> DataFrame:
    """From one-column tables, the values (as text) that occur at least ``limit`` times in all, by default once for each table."""
    wanted = len(sets) if limit is None else limit
    if wanted > len(sets):
        raise ValueError("vintersect: limit exceeds the number of tables")
    column = [s.select(F.col(s.columns[0]).cast("string").alias(name)) for s in sets]
    rows = reduce(DataFrame.unionAll, column)
    return rows.groupBy(name).agg(F.count("*").alias("n")).filter(F.col("n") >= wanted).select(name).orderBy(name)


def vcollapse(df: DataFrame, *columns: str, sep: str = "", fill: str | None = None) -> Column:
    """Each row's columns as one text without blanks; nulls become ``fill``, or raise if there is none."""
    parts = []
    for c in columns or df.columns:
        text = F.col(f"`{c}`").cast("string")
        gap = F.lit(fill) if fill is not None else F.raise_error(F.lit(f"vcollapse: null in {c} and no fill"))
        parts.append(F.regexp_replace(F.when(text.isNull(), gap.cast("string")).otherwise(text), " ", ""))
    return F.concat_ws(sep, *parts)
