"""Sharding by sampled splitters (DataFrame functions only): law ``bytes``.

A size-weighted sample of keys gives quantile boundaries for fine ranges, records are
range-partitioned by them, ranges that came out overfull are subdivided, and runs of neighbouring
ranges become shards by their exact bytes.  The key is (hash of text, hash of id), so equal texts
lie side by side; a group of copies stays whole unless it is larger than a fine range: then it is dealt by its ids, and
if rows of one id and text are repeated, by a serial number that each row gets when the records are written.

Defined cases: a null text has no bytes and weighs 8, its checksum is 0; a null id is an ordinary
key; repeated rows are records of their own, dealt like others, their slots are interchangeable; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.llm.common import durable

#: Fine ranges per shard, and sampled keys per fine range; both bound what is sorted in one task.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 128, 8
#: Key cells through which a record finds its splitters: the key's upper bits.
CELL_BITS = 12
#: A range of more than so many times the mean is subdivided.
OVERFULL = 2.0


def _unit(*cols) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(17), *cols), F.lit(1 << 30)) / float(1 << 30)


def _cell(k: Column) -> Column:
    return F.shiftright(k, 64 - CELL_BITS)


def splitters(records: DataFrame, ranges: int, total: int) -> DataFrame:
    """Boundaries (k, k2) at the quantiles of a size-weighted sample of at most about 8 keys a range.

    A text that is a boundary only once is not cut: its boundary comes before all its copies.
    """
    wanted = ranges * SAMPLES_PER_RANGE
    sample = records.select("k", "k2", F.floor(F.col("size") * (wanted / max(total, 1)) + _unit("k", "k2")).alias("w")).filter("w > 0")
    ordered = Window.orderBy("k", "k2")
    ranked = sample.select(
        "k", "k2", F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("w").over(Window.partitionBy()).alias("all")
    )
    part = F.floor(F.col("upto") * ranges / F.col("all"))
    marked = ranked.select("k", "k2", part.alias("part"), F.lag(part, 1, 0).over(ordered).alias("before")).filter("part > before")
    times = F.count("*").over(Window.partitionBy("k"))
    return marked.select("k", F.when(times > 1, F.col("k2")).otherwise(F.lit(-(1 << 63))).alias("k2")).distinct()


def _in_ranges(records: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds ``r``, the number of boundaries at or below each record's key; the cells' table has 2^12 rows."""
    cells = records.sparkSession.range(-(1 << (CELL_BITS - 1)), 1 << (CELL_BITS - 1), 1, 1).select(F.col("id").alias("cell"))
    held = bounds.groupBy(_cell(F.col("k")).cast("long").alias("cell")).agg(F.sort_array(F.collect_list(F.struct("k", "k2"))).alias("cuts"))
    table = cells.join(F.broadcast(held), "cell", "left")
    cuts = F.coalesce(F.size("cuts"), F.lit(0))
    below = F.sum(cuts).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    table = table.select("cell", F.coalesce(below, F.lit(0)).alias("base"), "cuts")
    here = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.struct("k", "k2"))), F.lit(0))
    return (
        records.withColumn("cell", _cell(F.col("k")).cast("long"))
        .join(F.broadcast(table), "cell")
        .withColumn("r", F.when(F.col("cuts").isNull(), F.col("base")).otherwise(F.col("base") + here))
        .drop("cell", "cuts", "base")
    )


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", fixed: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every record; the shards' bytes are nearly equal."""
    t = F.coalesce(F.col("t"), F.lit(""))
    records = durable(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).select(
            "doc_id",
            (F.octet_length(t) + F.lit(fixed)).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.xxhash64(t).alias("k"),
            F.xxhash64("doc_id").alias("k2"),
            F.xxhash64(F.monotonically_increasing_id()).alias("serial"),
        )
    )
    total = records.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    placed = durable(_in_ranges(records, splitters(records, ranges, total)))
    limit = OVERFULL * total / ranges
    mean = max(limit / OVERFULL, 1e-9)
    # texts that alone overfill a range are divided by themselves: fewer than `ranges` rows
    texts = placed.groupBy("k", "k2").agg(F.sum("size").alias("b"), F.count("*").alias("n")).groupBy("k").agg(F.sum("b").alias("b"), F.max("n").alias("n"))
    hot = texts.filter(F.col("b") > limit).select("k", F.ceil(F.col("b") / mean).alias("pieces"), (F.col("n") > 1).alias("twins"))
    stats = placed.groupBy("r").agg(F.sum("size").alias("b"))
    # at most half of the ranges can be overfull, so this side is bounded by their fixed number
    full = stats.filter(F.col("b") > limit).select("r", F.ceil(F.col("b") / mean).alias("m"))
    divided = placed.join(F.broadcast(full), "r", "left").join(F.broadcast(hot), "k", "left")
    within = F.when(F.col("twins"), F.xxhash64("k2", "serial")).otherwise(F.xxhash64("k2"))
    divided = divided.withColumns(
        {
            "sub": F.when(F.col("m").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("k"), F.col("m"))),
            "piece": F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod(within, F.col("pieces"))),
        }
    ).drop("m", "pieces", "twins")
    keys = ["r", "sub", "piece"]
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    mine = divided.groupBy(*keys).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    middle = F.coalesce(F.sum("b").over(before), F.lit(0)) + F.col("b") / 2
    mine = mine.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / max(total, 1)).cast("int")))
    mine = mine.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a few rows a fine range: a fixed number, whatever the input
    out = divided.join(F.broadcast(mine.select(*keys, "shard", "first")), keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("k", "k2", "doc_id", "serial"))
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + place - 1).cast("long").alias("slot"))
