"""Abundance over a stream of site reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions.ids import posid
from sitefold.operators.abundance import ONE_GROUP
from sitefold.schema import CORE, require, width


def stream_abundance(sites: DataFrame, grouping: str | None = None, replicates: str | None = None) -> DataFrame:
    """Running estAbund (distinct fragment lengths) by position and group, for update or complete mode.

    State is one row for each distinct (group, position, length, replicate), as the exact count needs.
    """
    require(sites, *CORE, *[c for c in (grouping, replicates) if c])
    rows = sites.select(
        posid().alias("posid"),
        (F.col(grouping).cast("string") if grouping else F.lit(ONE_GROUP)).alias("group"),
        width().alias("width"),
        (F.col(replicates).cast("string") if replicates else F.lit("1")).alias("replicate"),
    )
    return rows.dropDuplicates(["posid", "group", "width", "replicate"]).groupBy("posid", "group").agg(F.count("*").alias("estAbund"))
