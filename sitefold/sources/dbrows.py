"""Sites from rows of an integration-site database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.schema import require


def _first_of_each(df: DataFrame) -> DataFrame:
    """Drops columns whose name came before."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    first = {n: names.index(n) for n in reversed(names)}
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for n, i in sorted(first.items(), key=lambda x: x[1])])


def db_to_sites(rows: DataFrame, keep_additional_columns: bool = True, lower_case: bool = True, split_sample_name: bool = True) -> DataFrame:
    """Sites from chr, position, breakpoint (or length, which prevails), strand and sampleName.

    ``specimen`` is the sample's name up to its first hyphen; the names of metadata columns become lower case.
    """
    df = _first_of_each(rows)
    require(df, "chr", "position", "strand", "sampleName")
    plus = F.col("strand") == "+"
    if "length" in df.columns:
        end = F.when(plus, F.col("position") + F.col("length")).otherwise(F.col("position") - F.col("length"))
    else:
        require(df, "breakpoint")
        end = F.col("breakpoint")
    core = {
        "seqnames": F.col("chr"),
        "start": F.when(plus, F.col("position")).otherwise(end).cast("bigint"),
        "end": F.when(plus, end).otherwise(F.col("position")).cast("bigint"),
        "strand": F.col("strand"),
    }
    meta = {"sampleName": F.col("sampleName")}
    if split_sample_name:
        meta["specimen"] = F.substring_index("sampleName", "-", 1)
    if keep_additional_columns:
        used = {"chr", "position", "breakpoint", "strand", "sampleName"}
        meta |= {c: F.col(f"`{c}`") for c in df.columns if c not in used}
    return df.select(*[c.alias(n) for n, c in core.items()], *[c.alias(n.lower() if lower_case else n) for n, c in meta.items()])


#: The name by which users of genomic ranges know it.
db_to_granges = db_to_sites
