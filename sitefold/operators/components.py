"""Connected components on DataFrames, and key/value clustering.

Alternating large-star and small-star steps (Kiveris et al., 2014): rounds grow with the logarithm of the
nodes, each is one join and written to the checkpoint folder, and no node's edges are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.checkpoints import durable
from sitefold.schema import require


def _large_star(edges: DataFrame, by: list[str]) -> DataFrame:
    both = edges.select(*by, "u", "v").union(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("m"))
    return both.join(least, [*by, "u"]).filter("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, by: list[str]) -> DataFrame:
    down = edges.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(*by, "u").agg(F.min("v").alias("m"))
    moved = down.join(least, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(*by, "u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, by: list[str] | None = None, limit: int = 60) -> DataFrame:
    """(by..., node, label) of every node on an edge (by..., u, v); the label is the least node that can be reached within ``by``."""
    by = list(by or [])
    # kept with its loops: the edges are costly, and rounds, lone nodes and labels all come from them
    held = durable(edges.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops, now = held.filter("u = v"), held.filter("u <> v")
    last = None
    for _ in range(limit):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u", *by) % 998_244_353)).first()
        if seen == last:
            settled = now.select(*by, F.col("u").alias("node"), F.col("v").alias("label"))
            heads = now.select(*by, F.col("v").alias("node"), F.col("v").alias("label"))
            alone = loops.select(*by, F.col("u").alias("node"), F.col("v").alias("label"))
            return durable(settled.union(heads).union(alone).groupBy(*by, "node").agg(F.min("label").alias("label")))
        last = seen
        now = durable(_small_star(_large_star(now, by), by))
    raise RuntimeError("components did not settle")


def numbered(labels: DataFrame, name: str = "label", number: str = "clus", by: str | None = None) -> DataFrame:
    """``name`` and ``number``: distinct values counted from 1 in their order, by range partitions and their sizes; ``by`` starts anew for each of its values."""
    keys = [*([by] if by else []), name]
    ranged = durable(labels.select(*keys).distinct().repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    own = [*keys[:-1], "_part"]
    sizes = ranged.groupBy(*own).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*keys[:-1]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition (and value)
    before = sizes.select(*own, F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*own).orderBy(name))
    counted = ranged.withColumn("_place", place)
    counted = counted.join(before, own) if by else counted.join(F.broadcast(before), own)
    return counted.select(*keys, (F.col("before") + F.col("_place")).cast("bigint").alias(number))


def star_edges(pairs: DataFrame, key: str, val: str, by: list[str] | None = None) -> DataFrame:
    """For each value an edge from its least key to every key that has it; a value of one key makes a loop."""
    by = list(by or [])
    hub = pairs.groupBy(*by, val).agg(F.min(key).alias("v"), F.max(key).alias("_last"))
    # most values have one key: they make their loop where they are counted, and only the others meet their keys again
    loops = hub.filter("v = _last").dropna(subset=[*by, val]).select(*by, F.col("v").alias("u"), "v")
    edges = pairs.select(*by, val, F.col(key).alias("u")).join(hub.filter("v <> _last").drop("_last"), [*by, val]).select(*by, "u", "v")
    return edges.union(loops).distinct()


def cluster_kv(pairs: DataFrame, key: str = "key", val: str = "val", returns: str = "standard") -> DataFrame:
    """Clusters keys that share values, directly or through others; numbered by their least key.

    ``standard`` and ``data.frame``: the rows with ``clus``; ``simple``: one row a key; ``graph``: the edges
    between keys that share a value (u > v).
    """
    require(pairs, key, val)
    if returns not in ("standard", "data.frame", "simple", "graph"):
        raise ValueError(f"cluster_kv: unknown return {returns!r}")
    edges = star_edges(pairs.select(key, val), key, val)
    if returns == "graph":
        return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    found = components(edges)
    key_clus = found.join(numbered(found), "label").select(F.col("node").alias(key), "clus")
    if returns == "simple":
        return key_clus
    rows = pairs.join(key_clus, key, "left")
    return rows.select(*pairs.columns, "clus") if returns == "standard" else rows.select(key, val, "clus")


def bidirectional(edges: DataFrame) -> DataFrame:
    """Canonical ids "least:greatest" of the pairs that are linked in both directions."""
    ids = edges.filter("u <> v").select("u", "v").distinct().select(F.concat_ws(":", F.least("u", "v"), F.greatest("u", "v")).alias("edge_id"))
    return ids.groupBy("edge_id").agg(F.count("*").alias("n")).filter("n > 1").select("edge_id")


def one_direction(edges: DataFrame, prefer: Column) -> DataFrame:
    """Of the two edges of a bidirectional pair keeps the one for which ``prefer`` is least."""
    pair = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy(prefer, "u", "v")
    return edges.withColumn("_n", F.row_number().over(pair)).filter("_n = 1").drop("_n")
