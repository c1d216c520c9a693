"""Diversity of populations, one population per group.

Nulls are left out, except by UC50, whose result is null if the group has one.  A zero abundance makes the
logarithmic indices NaN, unless ``drop_zero`` is set.  Gini and UC50 work on the histogram of each
group's values, so no group is sorted as a whole: equal abundances lie on one straight stretch of the
Lorenz curve and need not be told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefold.schema import require

NAN = float("nan")


def _grouped(df: DataFrame, value: str, groups: list[str], drop_zero: bool) -> DataFrame:
    require(df, value, *groups)
    x = F.col(value).cast("double")
    rows = df.select(*groups, x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    return rows.filter("_x <> 0") if drop_zero else rows


def _logarithmic(df: DataFrame, value: str, groups: list[str], drop_zero: bool, index) -> DataFrame:
    """With S the sum and L the sum of x ln x, the sum of p ln p is L / S - ln S: one aggregation."""
    rows = _grouped(df, value, groups, drop_zero)
    agg = rows.groupBy(*groups).agg(
        F.sum("_x").alias("s"),
        F.sum(F.when(F.col("_x") > 0, F.col("_x") * F.log("_x")).otherwise(F.lit(NAN))).alias("l"),
        F.count("*").alias("n"),
    )
    plnp = F.col("l") / F.nullif(F.col("s"), F.lit(0.0)) - F.log("s")
    return agg.select(*groups, index(plnp, F.col("n")).alias("value"))


def calc_shannon(df: DataFrame, value: str, groups: list[str], base: float | None = None, drop_zero: bool = False) -> DataFrame:
    scale = 1.0 if base is None else F.log(F.lit(float(base)))
    return _logarithmic(df, value, groups, drop_zero, lambda h, n: -h / scale)


def calc_entropy(df: DataFrame, value: str, groups: list[str], drop_zero: bool = False) -> DataFrame:
    return calc_shannon(df, value, groups, 2.0, drop_zero)


def calc_clonality(df: DataFrame, value: str, groups: list[str], drop_zero: bool = False) -> DataFrame:
    """One member has no clonality: NaN."""
    return _logarithmic(df, value, groups, drop_zero, lambda h, n: F.when(n > 1, 1 + h / F.log(F.greatest(n, F.lit(2)))).otherwise(F.lit(NAN)))


def calc_gini(df: DataFrame, value: str, groups: list[str], weight: str | None = None) -> DataFrame:
    x = F.col(value).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    require(df, value, *groups, *([weight] if weight else []))
    rows = df.select(*groups, x.alias("_x"), w.alias("_w")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    bars = rows.groupBy(*groups, "_x").agg(F.sum("_w").alias("w"))
    order = Window.partitionBy(*groups).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    curve = bars.select(
        *groups, "_x", (F.sum("w").over(order) / F.sum("w").over(whole)).alias("W"),
        (F.sum(F.col("_x") * F.col("w")).over(order) / F.nullif(F.sum(F.col("_x") * F.col("w")).over(whole), F.lit(0.0))).alias("P"),
    )
    step = Window.partitionBy(*groups).orderBy("_x")
    cross = F.lead("P").over(step) * F.col("W") - F.col("P") * F.lead("W").over(step)
    return curve.select(*groups, cross.alias("c")).groupBy(*groups).agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("value"))


def calc_uc50(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """How many of the ascending running totals reach half of the whole."""
    require(df, value, *groups)
    if dict(df.dtypes)[value] in ("string", "boolean", "date", "timestamp"):
        raise ValueError("uc50 needs numbers")
    bars = df.groupBy(*groups, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("m"))
    bars = bars.withColumn("s", F.col("_x") * F.col("m"))
    order = Window.partitionBy(*groups).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    run = bars.select(
        *groups, "_x", "m", F.coalesce(F.sum("s").over(order), F.lit(0.0)).alias("c"),
        (F.sum("s").over(whole) / 2).alias("half"), F.max(F.col("_x").isNull()).over(whole).alias("gap"),
    )
    need = F.when(F.col("c") >= F.col("half"), 1.0).when(F.col("_x") > 0, F.ceil((F.col("half") - F.col("c")) / F.when(F.col("_x") > 0, F.col("_x"))).cast("double")).otherwise(F.col("m") + 1.0)
    reach = F.greatest(F.lit(0.0), F.least(F.col("m").cast("double"), F.col("m") - F.greatest(need, F.lit(1.0)) + 1))
    return run.groupBy(*groups).agg(F.when(~F.max("gap"), F.sum(reach)).cast("bigint").alias("value"))


CALCS = {"shannon": calc_shannon, "gini": calc_gini, "entropy": calc_entropy, "clonality": calc_clonality, "uc50": calc_uc50}


def pop_calcs(df: DataFrame, calc: str, value: str, groups: list[str] | None = None, **options) -> DataFrame | None:
    """The index named ``calc`` of each group (or of the whole table) as ``value``; None if there is no such index."""
    return CALCS[calc](df, value, list(groups or []), **options) if calc in CALCS else None

