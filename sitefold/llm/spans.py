"""Removal of repeated byte strings through a column-wise multi-document BWT.

Every 224-byte window of every text is anchored at its least 32-byte gram, so equal windows have
equal anchors at equal offsets.  Neighbouring windows with one anchor form a segment, which reaches 400 bytes beyond
its last window's start.  Segments are pre-aggregated by content, and the distinct segments that share an anchor form
a collection of short documents, aligned at the anchor.  From the right, each round inserts one symbol per document:
it reads the order of the suffixes and their common prefixes in sequence, emits the symbols
before them (the round's part of the collection's BWT), and writes order and common prefixes anew.
Where neighbours in the order share 400 bytes, their strings occur more than once and are removed; where they share 224
bytes, they make up passages, which are only reported (from 50 words on): a passage of over 50 words may be shorter than 400 bytes.

Only suffixes at equal distance from the anchor are ever compared, so a round's arrays hold one
entry per document and 592 rounds are enough for texts of any length.

An anchor with more than GROUP distinct segments (a very common passage in many contexts) is split by content, for each of the
two lengths: a range of starts has columns that all of its strings share, and only segments with the same content there can
have a string of the range in common.  Ranges are halved, so the shared columns widen, until a part has GROUP documents at most and is
built as above.  Parts are pre-aggregated by content again, which settles the inside of a common passage.

Defined cases: null text is empty; texts under 400 bytes lose nothing; repeated rows count as
separate occurrences; ids are only handed on; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.llm import shingles as S
from sitefold.llm.common import deleted, durable, shipped, small, stored

#: Length of the strings that are removed, of the windows that are looked for, and of the grams that anchor them.
LENGTH, SHORT, GRAM = 400, 224, 32
WIDTH = SHORT - GRAM + 1
#: Words from which a repeated run of windows is a passage.
PASSAGE_WORDS = 50
#: Distinct segments of one anchor, and of one collection, that a task builds at once; a larger anchor is split.
GROUP, COLLECTION = 8192, 4096
#: Keys of texts to be fetched again are broadcast up to so many rows, and found spans up to so many bytes.
BROADCAST_KEYS, BROADCAST_BYTES = 500_000, 16 << 20
PIECE = 1 << 18
U64 = np.uint64
NONE = 255  # no byte of UTF-8


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each 32-byte gram, by doubling."""
    h, n = S.BYTE[data], 1
    while n < GRAM:
        h = h[:-n] * U64(pow(int(S.BASE), n, 1 << 64)) + h[n:]
        n *= 2
    h ^= h >> U64(31)
    h *= U64(0x94D049BB133111EB)
    return h


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Of every window the place of its least gram, the leftmost of equals (block-wise running minima)."""
    n = len(hashes) - WIDTH + 1
    low = U64((1 << 20) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=U64)
    blocks = -(-len(key) // WIDTH)
    full = np.full(blocks * WIDTH, np.iinfo(U64).max, U64)
    full[: len(key)] = key
    grid = full.reshape(blocks, WIDTH)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[WIDTH - 1 : WIDTH - 1 + n]) & low).astype(np.int64)


def segments(data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor in the texts ``data[cuts[i]:cuts[i + 1]]``: text, first and last start, end of bytes, anchor (all within data) and the anchor's hash."""
    last = int(cuts[-1]) - SHORT
    at = 0
    while at <= last:
        to = min(at + PIECE, last + 1)
        hashes = gram_hashes(data[at : to + SHORT - 1])
        place = anchors(hashes)
        start = np.arange(at, to)
        text = np.searchsorted(cuts, start, side="right") - 1
        whole = start + SHORT <= cuts[text + 1]
        start, text, place = start[whole], text[whole], place[whole]
        beyond = to
        if len(start):
            new = np.flatnonzero((np.diff(place) != 0) | (np.diff(text) != 0) | (np.diff(start) != 1)) + 1
            first = np.concatenate(([0], new))
            final = np.concatenate((new - 1, [len(start) - 1]))
            if to <= last and start[-1] == to - 1 and start[first[-1]] > at:
                # the piece's last run may go on: it is left to the next piece
                beyond = int(start[first[-1]])
                first, final = first[:-1], final[:-1]
            stop = np.minimum(start[final] + LENGTH, cuts[text[final] + 1])
            yield text[first], start[first], start[final], stop, place[first] + at, hashes[place[first]]
        at = beyond


FOUND = "k1 bigint, k2 bigint, place bigint, h bigint, c1 bigint, c2 bigint"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, t) -> FOUND; a place packs the first start, the bytes up to the anchor, the number of starts and of bytes."""
    for batch in batches:
        for row, data, cuts in S.texts(batch.column(2)):
            raw = data.tobytes()
            for text, first, last, stop, anchor, h in segments(data, cuts):
                left, starts = anchor - first, last - first + 1
                marks = np.frombuffer(
                    b"".join([xxhash.xxh3_128_digest(raw[a:b], seed=c) for a, b, c in zip(first.tolist(), stop.tolist(), (left * 1024 + starts).tolist(), strict=True)]), "<i8"
                ).reshape(-1, 2)
                rows = pa.array(text + row)
                place = ((first - cuts[text]) << 26) | (left << 18) | (starts << 10) | (stop - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place), pa.array(h.view(np.int64)), pa.array(marks[:, 0]), pa.array(marks[:, 1])],
                    ["k1", "k2", "place", "h", "c1", "c2"],
                )


def _first() -> Column:
    return F.shiftrightunsigned("place", 26)


def _left() -> Column:
    return F.shiftrightunsigned("place", 18).bitwiseAND(255).cast("int")


def _starts() -> Column:
    return F.shiftrightunsigned("place", 10).bitwiseAND(255).cast("int")


def _size() -> Column:
    return F.col("place").bitwiseAND(1023).cast("int")


RAW = "h bigint, c1 bigint, c2 bigint, left int, run int, raw binary"


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text and its listed segments -> one row a segment, with the segment's bytes."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for text, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            for x in items:
                place = x["place"]
                a, n = place >> 26, place & 1023
                out.append((x["h"], x["c1"], x["c2"], (place >> 18) & 255, (place >> 10) & 255, raw[a : a + n]))
                size += n
            if size > 1 << 22:
                yield _batch(out, ["h", "c1", "c2", "left", "run", "raw"], types)
                out, size = [], 0
        yield _batch(out, ["h", "c1", "c2", "left", "run", "raw"], types)


def _batch(out: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)


def rounds(columns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Column-wise construction over aligned documents (``columns[c]`` has each document's byte at c, or NONE).

    After the round of column c: c, the documents in the order of their suffixes from c, the common
    prefixes of neighbours (entry i for i - 1 and i), and the BWT's symbols as read in this round.
    """
    m = columns.shape[1]
    order = np.arange(m)
    common = np.zeros(m, np.int32)
    for c in range(len(columns) - 1, -1, -1):
        symbols = columns[c][order]
        move = np.argsort(symbols, kind="stable")
        moved = symbols[move]
        fresh = np.zeros(m, np.int32)
        same = np.flatnonzero((moved[1:] == moved[:-1]) & (moved[1:] != NONE))
        low, high = move[same] + 1, move[same + 1]
        value = common[high]
        wide = np.flatnonzero(low < high)
        if len(wide):
            # the least common prefix between documents that were apart in the order
            ends = np.empty(2 * len(wide), np.int64)
            ends[0::2], ends[1::2] = low[wide], high[wide]
            value[wide] = np.minimum(np.minimum.reduceat(common, ends)[0::2], common[high[wide]])
        fresh[same + 1] = value + 1
        order, common = order[move], fresh
        yield c, order, common, symbols


def reach(raws: list[bytes], firsts: list[int]) -> np.ndarray:
    """For each document, whose bytes begin in column ``firsts[i]``, and each start column the longest prefix that it shares with another one there."""
    columns = np.full((WIDTH - 1 + LENGTH, len(raws)), NONE, np.uint8)
    for i, (raw, a) in enumerate(zip(raws, firsts, strict=True)):
        columns[a : a + len(raw), i] = np.frombuffer(raw, np.uint8)
    out = np.zeros((len(raws), WIDTH), np.int16)
    for c, order, common, _ in rounds(columns):
        if c < WIDTH:
            out[order, c] = common
            np.maximum.at(out[:, c], order[:-1], common[1:].astype(np.int16))
    return out


def covers(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The columns under strings of ``size`` that begin at the ascending ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > size) + 1
    return [(int(a), int(b) + size) for a, b in zip(starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))], strict=True)]


SPAN = "c1 bigint, c2 bigint, size int, lo int, hi int"


def _judged(rows: list[tuple], sizes) -> pa.RecordBatch:  # noqa: ANN001
    """From rows of (..., c1, c2, first column, starts, bytes): the spans of columns of each length in ``sizes`` of the row."""
    far = reach([r[-1] for r in rows], [r[-3] for r in rows])
    out = []
    for row, found in zip(rows, far, strict=True):
        a = row[-3]
        for size in sizes(row):
            starts = a + np.flatnonzero(found[a : a + row[-2]] >= size)
            out += [(row[-5], row[-4], size, x, y) for x, y in covers(starts, size)]
    return _batch(out, ["c1", "c2", "size", "lo", "hi"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()])


def _built(width: int, sizes):  # noqa: ANN001, ANN202
    """Collections of whole groups from rows sorted by their first ``width`` columns, the group; groups of one length go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (sizes(row) != sizes(held[-1]) or (len(held) >= COLLECTION and row[:width] != held[-1][:width])):
                    yield _judged(held, sizes)
                    held = []
                held.append(row)
        if held:
            yield _judged(held, sizes)

    return run


NODE = ["size", "lo", "hi", "g1", "g2"]
PART = "size int, lo int, hi int, g1 bigint, g2 bigint, u1 bigint, u2 bigint, c1 bigint, c2 bigint, a int, n int, raw binary"


def _parts(first: bool):  # noqa: ANN202
    """Rows (size, lo, hi, c1, c2, a, n, raw): bytes from column a on with n starts from there -> the halves of the range of starts lo..hi.

    A part has the 128-bit names of the columns that all strings of its range share and of its own bytes.  The strings to be removed
    are first split by their shared columns in the whole range.
    """
    types = [pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.int32(), pa.int32(), pa.binary()]
    names = [x.split(" ")[0] for x in PART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                out = []
                for size, lo, hi, c1, c2, a, n, raw in zip(*[c.to_pylist() for c in batch.slice(at, 2000).columns], strict=True):
                    mid = (lo + hi) // 2
                    for x, y in [(lo, hi)] if first and size == LENGTH else [(lo, mid), (mid, hi)]:
                        s, e = max(a, x), min(a + n, y, a + len(raw) - size + 1)
                        if s < e:
                            own = raw[s - a : e - 1 - a + size]
                            seed = (size << 40) | (x << 30) | (y << 20)
                            g = xxhash.xxh3_128_digest(raw[y - 1 - a : x + size - a], seed=seed)
                            u = xxhash.xxh3_128_digest(own, seed=seed | (s << 10) | e)
                            out.append((size, x, y, *struct.unpack("<qq", g), *struct.unpack("<qq", u), c1, c2, s, e - s, own))
                yield _batch(out, names, types)

    return run


def crowded_spans(raws: DataFrame) -> DataFrame:
    """c1, c2 and the spans of columns (size, lo, hi) of segments (RAW) whose anchors have too many of them for one task."""
    a = (F.lit(WIDTH - 1) - F.col("left")).cast("int")
    sizes = F.explode(F.array(F.lit(SHORT), F.lit(LENGTH))).alias("size")
    rows = raws.select(sizes, F.lit(0).alias("lo"), F.lit(WIDTH).alias("hi"), "c1", "c2", a.alias("a"), F.col("run").alias("n"), "raw")
    levels = []
    # at most nine rounds: a range of one start is settled by the names alone
    while not levels or rows.limit(1).count():
        parts = durable(rows.mapInArrow(_parts(not levels), PART))
        kinds = parts.groupBy(*NODE, "u1", "u2").agg(F.count("*").alias("k"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("raw").alias("raw"))
        kinds = durable(kinds)
        groups = kinds.groupBy(*NODE).agg(F.count("*").alias("m")).filter("m > 1")
        open_ = durable(kinds.filter("hi - lo > 1").join(groups, NODE).select("m", *NODE, "u1", "u2", "a", "n", "raw"))
        same = kinds.filter("k > 1").select("u1", "u2", "size", F.col("a").alias("lo"), (F.col("a") + F.col("n") - 1 + F.col("size")).alias("hi"))
        built = open_.filter(F.col("m") <= GROUP).drop("m").repartition(*NODE).sortWithinPartitions(*NODE).mapInArrow(_built(5, lambda r: (r[0],)), SPAN)
        levels.append((parts.select("c1", "c2", "u1", "u2"), durable(same.union(built))))
        rows = open_.filter(F.col("m") > GROUP).select("size", "lo", "hi", F.col("u1").alias("c1"), F.col("u2").alias("c2"), "a", "n", "raw")
    held = None
    for links, found in reversed(levels):
        all_ = found.toDF("u1", "u2", "size", "lo", "hi")
        all_ = all_.union(held) if held is not None else all_
        held = durable(links.join(all_, ["u1", "u2"]).select("c1", "c2", "size", "lo", "hi").distinct())
    return held


COVER = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping spans of one length become one."""
    for batch in batches:
        out = []
        for spans in batch.column(2).to_pylist():
            out.append([{"size": n, "lo": a, "hi": b} for n in (SHORT, LENGTH) for a, b in merged([(x["lo"], x["hi"]) for x in spans if x["size"] == n])])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.column(2).type)], ["k1", "k2", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans in any order -> merged spans, what is left of the bytes, and passages."""
    names = ["doc_id", "n_bytes", "spans", "kept", "passages"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            gone, kept, sizes, passages = [], [], [], []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                own = merged([(x["lo"], x["hi"]) for x in spans or () if x["size"] == LENGTH])
                runs = merged([(x["lo"], x["hi"]) for x in spans or ()])
                ends = [0, *[x for ab in own for x in ab], len(raw)]
                gone.append([{"from": a, "to": b} for a, b in own])
                kept.append(b"".join([raw[a:b] for a, b in zip(ends[0::2], ends[1::2], strict=True)]))
                sizes.append(len(raw))
                passages.append([{"from": a, "to": b} for a, b in runs if len(raw[a:b].split()) >= PASSAGE_WORDS])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, COVER), pa.array(kept, pa.binary()), pa.array(passages, COVER)], names)


def _raws(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the segments in ``wanted``, each from one text."""
    lists = durable(wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c1", "c2", "place")).alias("items")))
    near = small(lists.select("k1", "k2"), lists.count(), BROADCAST_KEYS)
    held = texts.join(near, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return held.join(lists, ["k1", "k2"]).select("t", "items").mapInArrow(_bytes_of, RAW)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """k1, k2 and spans (size, lo, hi) of the texts (k1, k2, t) that hold repeated strings; equal texts have one row."""
    spark = texts.sparkSession
    found, at = stored(texts.mapInArrow(_found, FOUND))
    # written first, so that a hot anchor's rows can be split in the join
    often = durable(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    members, own = stored(found.join(often, "h"))
    deleted(spark, at)
    # equal segments are one, with their number and one place
    kinds, of = stored(members.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("at")))
    groups = durable(kinds.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"))
    wanted = kinds.join(groups, "h").select("m", "h", "c1", "c2", "at.*")
    few = _raws(texts, wanted.filter(F.col("m") <= GROUP))
    # rows as (anchor's hash, c1, c2, first column, starts, bytes)
    few = few.select("h", "c1", "c2", (F.lit(WIDTH - 1) - F.col("left")).cast("int").alias("a"), F.col("run").alias("n"), "raw")
    spans = durable(few.repartition("h").sortWithinPartitions("h").mapInArrow(_built(1, lambda r: (SHORT, LENGTH)), SPAN))
    if groups.filter(F.col("m") > GROUP).limit(1).count():
        spans = spans.union(crowded_spans(durable(_raws(texts, wanted.filter(F.col("m") > GROUP)))))
    listed = spans.groupBy("c1", "c2").agg(F.collect_set(F.struct("size", "lo", "hi")).alias("spans"))
    judged = durable(kinds.select("c1", "c2", (F.col("n") > 1).alias("all")).join(listed, ["c1", "c2"], "left").filter(F.col("all") | F.col("spans").isNotNull()))
    # all windows of a segment that occurs twice, or the found ones, as places in the text
    span = lambda n, lo, hi: F.struct(F.lit(n).alias("size"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    short = span(SHORT, _first(), _first() + _starts() + (SHORT - 1))
    whole = F.when(_size() >= LENGTH, F.array(short, span(LENGTH, _first(), _first() + _size()))).otherwise(F.array(short))
    zero = _first() + _left() - (WIDTH - 1)
    part = F.transform("spans", lambda x: F.struct(x["size"].alias("size"), (zero + x["lo"]).alias("lo"), (zero + x["hi"]).alias("hi")))
    cut = members.join(judged, ["c1", "c2"]).select("k1", "k2", F.explode(F.when(F.col("all"), whole).otherwise(part)).alias("s"))
    by_text = cut.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))
    out = durable(by_text.mapInArrow(_joined, "k1 bigint, k2 bigint, spans array<struct<size:int,lo:bigint,hi:bigint>>"))
    deleted(spark, own, of)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes), kept (the remaining bytes) and passages of every row."""
    shipped(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = dict(base.dtypes)["doc_id"]
    # a text goes by its 128-bit name
    named = base.select(F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(1), "t").alias("k2"), "t", "doc_id")
    by_text = repeated_spans(named.filter(F.octet_length("t") >= SHORT).select("k1", "k2", "t"))
    weight = by_text.agg(F.sum(F.size("spans") * 40 + 64)).first()[0] or 0
    by_text = F.broadcast(by_text) if weight <= BROADCAST_BYTES else by_text
    both = named.join(by_text, ["k1", "k2"], "left").select("doc_id", "t", "spans")
    spans = "array<struct<from:bigint,to:bigint>>"
    return both.mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, spans {spans}, kept binary, passages {spans}")
