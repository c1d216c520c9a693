"""Distinct ranges with their metadata."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.schema import CORE, metadata, require


def _without_twins(df: DataFrame, pattern: str | None) -> DataFrame:
    """Among metadata columns that go by one name (or one match of ``pattern``), drops those equal to an earlier one; what is left of a group takes its name."""
    groups: dict[str, list[int]] = {}
    names = list(df.columns)
    for i, name in enumerate(names):
        if name in CORE:
            continue
        found = re.search(pattern, name) if pattern else None
        groups.setdefault(found.group(0) if found else name, []).append(i)
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    pairs = [(a, b) for g in groups.values() for n, b in enumerate(g) for a in g[:n]]
    gone: set[int] = set()
    if pairs:
        same = plain.agg(*[F.bool_and(F.col(f"_c{a}").eqNullSafe(F.col(f"_c{b}"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        for i, (a, b) in enumerate(pairs):
            if same[i] is not False and a not in gone:
                gone.add(b)
    kept = {i: g for g, members in groups.items() for i in members}
    return plain.select(*[F.col(f"_c{i}").alias(kept.get(i, n)) for i, n in enumerate(names) if i not in gone])


def unique_granges(sites: DataFrame, sum_cols: bool | list[str] | None = None, rm_cols: list[str] | None = None, rm_dup_cols: bool | str | None = None) -> DataFrame:
    """Distinct rows; ``sum_cols`` (True: the column counts) are summed over rows that are otherwise equal.

    ``rm_cols`` are dropped first, absent ones with a warning.  ``rm_dup_cols`` drops columns with the content of an
    earlier one of the same name, or of the same match of a pattern.
    """
    require(sites, *CORE)
    if rm_cols:
        absent = [c for c in rm_cols if c not in sites.columns]
        if absent:
            warnings.warn(f"no such columns: {', '.join(absent)}", stacklevel=2)
        sites = sites.drop(*[c for c in rm_cols if c in metadata(sites)])
    if rm_dup_cols:
        sites = _without_twins(sites, rm_dup_cols if isinstance(rm_dup_cols, str) else None)
    if not sum_cols:
        return sites.distinct()
    sums = ["counts"] if sum_cols is True else list(sum_cols)
    require(sites, *sums)
    keys = [c for c in sites.columns if c not in sums]
    return sites.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).select(*sites.columns)


def union_of(tables: list[DataFrame]) -> DataFrame:
    """All rows, with nulls for columns that a table lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
