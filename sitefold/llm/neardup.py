"""MinHash near-duplicates by an inverted join on signature coordinates.

Texts with equal sets of shingles are one node.  A node's signature has 48 coordinates; a pair at the threshold agrees on
``matches_for`` of them or more, but for one pair in a million.  Nodes are posted under their coordinate-value pairs:
pairs that only one node has are skipped, and of the others each node posts only a prefix, its rarest ones, which is long enough that
two nodes with enough coordinates in common meet in both prefixes.

Postings are not expanded into all pairs.  First each member of a posting list is held against the list's
hub only.  After components, the members of lists that still hold several components are merged in tiles of bounded size: for each
member the shortest lists of its coordinates are merged and the longest are skipped, the members met are probed on all coordinates, and
of the pairs with enough collisions only those that connect two components leave the tile.  Lists with equal members are merged once.
Whatever has enough collisions is confirmed on the full sets.

Defined cases: null, empty and word-less texts have no shingles and stand alone; repeated rows
are copies; null ids are allowed, the smallest id that is not null names a component; an empty
table gives an empty result; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm import shingles as S
from sitefold.llm.common import durable, shipped, small
from sitefold.operators.components import components

#: How often a pair at the threshold may agree on too few coordinates to be held against each other.
MISSED = 1e-6
#: Members and shingles of a posting list's tile; longer lists are dealt over pairs of tiles.
TILE_NODES, TILE_SHINGLES = 2048, 400_000
#: Lists of nodes are broadcast up to so many rows of 24 bytes.
BROADCAST_NODES = 300_000


def matches_for(percent: int) -> int:
    """Coordinates on which a pair must agree: with similarity s it agrees on Binomial(COORDINATES, s) of them."""
    p = percent / 100
    below, k = 0.0, 0
    while below + (more := math.comb(S.COORDINATES, k) * p**k * (1 - p) ** (S.COORDINATES - k)) <= MISSED:
        below, k = below + more, k + 1
    return max(k, 1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(S.sets(batch.column(1)))
        signed = [S.signature(x).view("int64") if len(x) else [] for x in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in found], pa.int64()), S.names(found), pa.array(signed, pa.list_(pa.int64())), *batch.columns[2:]],
            ["doc_id", "n_shingles", "node", "sig", *batch.schema.names[2:]],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(S.sets(batch.column(1)))
        yield pa.RecordBatch.from_arrays([S.names(found), pa.array([x.view("int64") for x in found], pa.list_(pa.int64()))], ["node", "items"])


def _colliding(pairs: DataFrame, nodes: DataFrame, enough: int) -> DataFrame:
    """The pairs (u, v) whose signatures agree on enough coordinates."""
    left = nodes.select(F.col("node").alias("u"), F.col("sig").alias("a"))
    right = nodes.select(F.col("node").alias("v"), F.col("sig").alias("b"))
    both = pairs.join(left, "u").join(right, "v")
    return both.filter(F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x)) >= enough).select("u", "v")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of ``percent`` / 100 or more."""
    left = full.select(F.col("node").alias("u"), F.col("items").alias("a"))
    right = full.select(F.col("node").alias("v"), F.col("items").alias("b"))
    joined = pairs.select("u", "v").join(left, "u").join(right, "v")
    # sets of too unequal size cannot be that similar
    sized = joined.filter((100 * F.size("a") >= percent * F.size("b")) & (100 * F.size("b") >= percent * F.size("a")))
    both = sized.select("u", "v", (F.size("a") + F.size("b")).alias("total"), F.size(F.array_intersect("a", "b")).alias("same"))
    return both.filter(100 * F.col("same") >= percent * (F.col("total") - F.col("same"))).select("u", "v")


def tile_links(items: list[np.ndarray], sigs: np.ndarray, labels: list, sides: list[int], both: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs of members that reach the threshold and connect two components (a spanning choice).

    In a tile of two sides only members of different sides are compared.
    """
    enough, width = matches_for(percent), sigs.shape[1]
    flat = sigs.ravel()
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(new)
    counts = np.diff(np.concatenate((starts, [len(flat)])))
    run = np.empty(len(flat), np.int64)
    run[order] = np.cumsum(new) - 1
    run = run.reshape(sigs.shape)
    members = order // width
    side = np.array(sides)
    parent = {x: x for x in labels}

    def root(x):  # noqa: ANN001, ANN202
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x in range(len(items)):
        mine = run[x]
        # the longest enough - 1 lists are skipped: a pair with enough collisions is met in the others
        mine = mine[np.argsort(counts[mine], kind="stable")[: width - enough + 1]]
        mine = mine[counts[mine] > 1]
        if not len(mine):
            continue
        lens = counts[mine]
        at = np.repeat(starts[mine] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(int(lens.sum()))
        met = np.unique(members[at])
        met = met[met > x]
        if both:
            met = met[side[met] != side[x]]
        if not len(met):
            continue
        hits = (sigs[met] == sigs[x]).sum(1)
        keep = hits >= enough
        for y in met[keep][np.argsort(-hits[keep], kind="stable")].tolist():
            a, b = root(labels[x]), root(labels[y])
            if a != b and similar(items[x], items[y], percent):
                parent[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _merged(percent: int):  # noqa: ANN202
    """Tiles from rows sorted by (token, i, j): token, i, j, node, label, side, sig, items -> links."""

    def tile(rows: list[tuple]) -> list[tuple]:
        labels = [r[4] for r in rows]
        if len(set(labels)) < 2:
            return []
        found = tile_links([r[7] for r in rows], np.array([r[6] for r in rows]), labels, [r[5] for r in rows], rows[0][1] != rows[0][2], percent)
        return [(rows[x][3], rows[y][3]) for x, y in found]

    def batch_of(links: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], S.NAME), pa.array([v for _, v in links], S.NAME)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        links: list[tuple] = []
        for batch in batches:
            slim = [batch.column(k).to_pylist() for k in range(6)]
            sigs, sets = batch.column(6), batch.column(7)
            for k in range(batch.num_rows):
                row = (*[c[k] for c in slim], *[x[k].values.to_numpy(zero_copy_only=False) for x in (sigs, sets)])
                if held and row[:3] != held[-1][:3]:
                    links += tile(held)
                    held = []
                held.append(row)
            yield batch_of(links)
            links = []
        yield batch_of(tile(held) if held else [])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; ``by_row``: doc_id, key (the text's hash), whether it has a word and whether its component goes by another id or text."""
    shipped(docs.sparkSession)
    enough = matches_for(percent)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = dict(base.dtypes)["doc_id"]
    if by_row:
        base = base.withColumn("key", F.xxhash64("t"))
    signed = durable(base.mapInArrow(_signatures, f"doc_id {kind}, n_shingles bigint, node {S.NAME_SQL}, sig array<bigint>{', key bigint' if by_row else ''}"))
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig"))
    postings = nodes.select("node", F.explode("sig").alias("token"))
    shared = durable(postings.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"))
    # of a node's shared tokens the rarest, but for the enough - 1 most frequent ones
    met = postings.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))
    prefix = F.slice("own", 1, F.size("own") - (enough - 1))
    posted = durable(met.filter(F.size("own") >= enough).select("node", F.explode(prefix).alias("x")).select("node", F.col("x.token").alias("token")))
    lists = durable(posted.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    held = durable(posted.join(lists.select("token", "hub"), "token"))

    names = durable(held.select("node").distinct().join(signed.select("node", "doc_id", "sig"), "node").groupBy("node").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig")))
    count = names.count()
    wanted = small(names.select("id"), count, BROADCAST_NODES)
    picked = base.join(wanted, base["doc_id"].eqNullSafe(wanted["id"]), "left_semi")
    full = picked.mapInArrow(_full_sets, f"node {S.NAME_SQL}, items array<bigint>").filter("node is not null")
    full = durable(full.join(small(names.select("node"), count, BROADCAST_NODES), "node", "left_semi").dropDuplicates(["node"]))

    hubs = held.filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    links = durable(_confirmed(_colliding(hubs, names, enough), full, percent))
    labels = components(links)
    # lists that still hold several components, one of those with equal members, and the tiles that they take
    named = held.join(labels, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    sized = durable(named.join(full.select("node", F.size("items").alias("n")), "node"))
    members = F.struct(F.count("*"), F.sum(F.xxhash64("node").cast("decimal(20,0)")), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(20,0)")))
    open_ = sized.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("g"), F.sum("n").alias("s"), members.alias("of")).filter("lo < hi")
    open_ = durable(open_.groupBy("of").agg(F.min(F.struct("token", "g", "s")).alias("x")).select("x.*"))
    tiles = F.ceil(F.greatest(F.col("g") / TILE_NODES, F.col("s") / TILE_SHINGLES))
    rest = sized.join(open_.select("token", tiles.alias("tiles")), "token").withColumn("side", F.pmod(F.xxhash64("node"), F.col("tiles")))
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1), lambda k: F.struct(F.least("side", k).alias("i"), F.greatest("side", k).alias("j")))
    dealt = rest.select("token", "node", "label", "side", F.explode(cells).alias("c")).select("token", "c.i", "c.j", "node", "label", "side")
    dealt = dealt.join(full, "node").join(names.select("node", "sig"), "node").select("token", "i", "j", "node", "label", "side", "sig", "items")
    more = durable(dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_merged(percent), f"u {S.NAME_SQL}, v {S.NAME_SQL}").distinct())
    if more.limit(1).count():
        labels = components(links.union(more))
    grouped = durable(signed.drop("sig").join(labels, "node", "left").withColumn("group", F.coalesce("label", "node")))
    if by_row:
        # an id before no id, then the smallest id and text hash
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
        heads = grouped.filter("group is not null").groupBy("group").agg(F.min(order).alias("head"))
        same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("key") == F.col("head.key"))
        worded = F.col("group").isNotNull()
        return grouped.join(heads, "group", "left").select("doc_id", "key", worded.alias("worded"), (worded & ~same).alias("extra"))
    heads = grouped.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("head"))
    out = grouped.join(heads, "group", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("head", "doc_id").alias("component_id"))
