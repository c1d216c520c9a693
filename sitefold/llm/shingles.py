"""Word shingles and MinHash signatures of texts, vectorised over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random value for each byte, and the powers that tell a word's positions apart.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
#: Shingle length in words, and the multipliers that set the places of a shingle's words apart.
WORDS = 5
PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Coordinates of a MinHash signature.
COORDINATES = 48
MASK = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.int64).astype(U64)
MULT = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are handled at once (a longer text is handled by itself).
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts ``data[cuts[i]:cuts[i + 1]]``, and the number of words before each cut."""
    low = _LOWER[data]
    gap = _SPACE[low]
    first = ~gap
    edge = first.copy()
    edge[1:] &= gap[:-1]
    inner = cuts[1:-1]
    inner = inner[inner < len(data)]
    edge[inner] = first[inner]
    starts = np.flatnonzero(edge)
    if not len(starts):
        return np.empty(0, U64), np.zeros(len(cuts), np.int64)
    offset = np.arange(len(data), dtype=np.int64)
    offset -= starts[np.maximum(np.cumsum(edge) - 1, 0)]
    offset[gap] = 0
    np.maximum(offset, 0, out=offset)
    value = BYTE[low] * _powers(int(offset.max()) + 1)[offset]
    value[gap] = 0
    sums = np.add.reduceat(value, starts)
    return mix(sums), np.searchsorted(starts, cuts)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of one text's shingles; a text of fewer words is one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, U64)
    width = min(n, WORDS)
    total = np.zeros(n - width + 1, U64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * PLACE[k]
    return np.unique(mix(total + U64(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """A set's coordinate-value pairs, each as one number: the least value under a coordinate's hash, and the coordinate."""
    least = np.full(COORDINATES, np.iinfo(U64).max, U64)
    for at in range(0, len(shingles), 512):
        part = (shingles[None, at : at + 512] ^ MASK[:, None]) * MULT[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return mix(mix(least) + np.arange(COORDINATES, dtype=U64) * BASE)


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of at most CHUNK bytes or one text: first row, bytes, cuts."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, side="right")) - 1)
        yield at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, in the order of rows."""
    for _, data, cuts in texts(column):
        words, before = word_hashes(data, cuts)
        for i in range(len(cuts) - 1):
            yield shingle_hashes(words[before[i] : before[i + 1]])


def names(sets_: list[np.ndarray]) -> pa.Array:
    """126-bit names of sets of shingles; null for empty ones."""
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.tobytes()) for x in sets_]), np.uint8).reshape(-1, 16).copy()
    raw[:, 15] &= 0x3F  # so that they fit into 38 digits
    full = np.array([len(x) > 0 for x in sets_], bool)
    valid = pa.py_buffer(np.packbits(full, bitorder="little").tobytes())
    return pa.Array.from_buffers(NAME, len(sets_), [valid, pa.py_buffer(raw.tobytes())])


#: Names of sets, in Arrow and in SQL.
NAME, NAME_SQL = pa.decimal128(38, 0), "decimal(38,0)"
