"""Random sites for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_sites(
    spark: SparkSession, n_sites: int = 5, n_reads_p_site: int = 20, site_range: tuple[int, int] = (1, 1000), width_range: tuple[int, int] = (30, 100), stdev: float = 1.0, positions: list[int] | None = None, seed: int = 1
) -> DataFrame:
    """Reads on chr1 + whose starts scatter normally around sites; read i of every site has the same width."""
    reads = spark.range(n_sites * n_reads_p_site)
    site, read = F.floor(F.col("id") / n_reads_p_site), F.col("id") % n_reads_p_site
    within = lambda x, salt, bounds: F.lit(bounds[0]) + F.pmod(F.xxhash64(x, F.lit(seed), F.lit(salt)), F.lit(bounds[1] - bounds[0] + 1))
    centre = F.element_at(F.array(*[F.lit(p) for p in positions]), (site + 1).cast("int")) if positions else within(site, 1, site_range)
    start = F.greatest(F.lit(1), centre + F.rint(F.randn(seed) * stdev)).cast("bigint")
    rows = reads.select(start.alias("start"), within(read, 2, width_range).cast("bigint").alias("w"))
    return rows.select(F.lit("chr1").alias("seqnames"), "start", (F.col("start") + F.col("w") - 1).alias("end"), F.lit("+").alias("strand"))
