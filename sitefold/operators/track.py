"""Clones that several sets of sites share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions.ids import posid
from sitefold.operators.islands import bin_of
from sitefold.schema import CORE, five_prime, packed, require


def shared_points(sites: DataFrame, origin: str, gap: int) -> DataFrame:
    """Distinct (seqnames, strand, pos, origin) with a point of another set at most ``gap`` away on a strand that fits (* fits both).

    Instead of joining points with points, the least and the greatest set name within reach are windowed: another
    set is there if either is not the point's own.  Windows cover a bin, points near an edge are also in the next.
    """
    points = sites.select("seqnames", "strand", five_prime().alias("pos"), F.col(origin).alias("o")).distinct()
    sides = F.explode(F.when(F.col("strand") == "*", F.array(F.lit("+"), F.lit("-"))).otherwise(F.array("strand")))
    bins = F.array_distinct(F.sequence(bin_of(F.col("pos") - gap), bin_of(F.col("pos") + gap)))
    spread = points.withColumn("side", sides).withColumn("bin", F.explode(bins))
    reach = Window.partitionBy("seqnames", "side", "bin").orderBy("pos").rangeBetween(-gap, gap)
    seen = spread.withColumns({"lo": F.min("o").over(reach), "hi": F.max("o").over(reach)})
    home = seen.filter((F.col("bin") == bin_of(F.col("pos"))) & ((F.col("lo") != F.col("o")) | (F.col("hi") != F.col("o"))))
    return home.select("seqnames", "strand", "pos", "o").distinct()


def track_clones(sites: DataFrame | dict[str, DataFrame] | list[DataFrame], gap: int = 5, track_origin: bool = True, origin: str = "origin") -> DataFrame:
    """Distinct rows that have a partner in another set, with ``posid``; sets are told apart by ``origin``.

    Rows without a sequence, strand, position or set have no partner; an empty table gives an empty result.
    """
    if not isinstance(sites, DataFrame):
        named = sites.items() if isinstance(sites, dict) else [(str(i + 1), s) for i, s in enumerate(sites)]
        tables = [s.withColumn(origin, F.lit(n)) for n, s in named]
        sites = tables[0]
        for t in tables[1:]:
            sites = sites.unionByName(t, allowMissingColumns=True)
    require(sites, *CORE, origin)
    found = shared_points(sites, origin, gap)
    rows = packed(sites, on=F.col("seqnames"), side=F.col("strand"), at=five_prime(), of=F.col(origin), posid=posid())
    own = (F.col("on") == F.col("seqnames")) & (F.col("side") == F.col("strand")) & (F.col("at") == F.col("pos")) & (F.col("of") == F.col("o"))
    kept = rows.join(found, own, "left_semi").select("row.*", "posid")
    return (kept if track_origin else kept.drop(origin)).distinct()
