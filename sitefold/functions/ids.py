"""Position identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.schema import five_prime, require


def posid(delim: str = "") -> Column:
    """seqnames, strand and the 5' base, joined by ``delim``; null if any part is."""
    return F.concat("seqnames", F.lit(delim), "strand", F.lit(delim), five_prime().cast("string"))


def generate_posid(sites: DataFrame, delim: str = "", name: str = "posid") -> DataFrame:
    require(sites, "seqnames", "start", "end", "strand")
    return sites.withColumn(name, posid(delim))
