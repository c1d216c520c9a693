"""BPE with word ends: encoding as a streaming transducer, decoding as a state machine.

A word's symbols enter a window as long as the longest token, the merge list's sufficient lookahead:
whatever follows, the encoding has a boundary among the last that many positions.  A word that
fits into the window is merged there.  For a longer one the transducer keeps, for each position
of the window, the last token of the encoding that ends there (two tokens may follow each other
only if together they encode to themselves), and emits the tokens on which all of the window's
encodings agree.  So memory does not grow with a word, and texts are read in pieces cut at blanks.

Defined cases: null text reads as empty and has no ids; repeated rows are encoded each; an empty
table gives an empty result; strings of special tokens in a text become those tokens, as in
the library; other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

from sitefold.llm.common import shipped

#: Words kept with their encodings by each worker, in each of two generations; words that are met again move to the younger one.
KEPT_WORDS = 100_000
#: Characters of a text that are handled at once.
PIECE = 1 << 20
#: Fixed value: what the tokenizer file's splitter keeps.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Bpe:
    """A tokenizer of the described kind, from the text of its JSON file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): n for n, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.symbols = byte_symbols()
        self.table = {b: c for b, c in self.symbols.items()}
        self.inner = {t: i for t, i in self.vocab.items() if not (self.suffix and t.endswith(self.suffix))}
        self.last = {t[: -len(self.suffix)]: i for t, i in self.vocab.items() if self.suffix and t.endswith(self.suffix)}
        #: The sufficient lookahead, in symbols.
        self.lookahead = max(max(map(len, self.inner)), max(map(len, self.last), default=1))
        self.by_byte = np.array([[self.inner[c], self.last.get(c, self.inner[c])] for _, c in sorted(self.symbols.items())], np.int64)
        self.ranks = PairTable(self.rank)
        self.made_ids = np.array([*self.made, 0], np.int64)
        self.fits: dict[tuple[int, int], bool] = {}
        self.byte_tables: dict[bool, list[bytes]] = {}
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(regex.escape(m) for m in marks)) if marks else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def atoms(self, word: str) -> list[int]:
        """The symbols of a word, the last one with the word's end."""
        ids = [self.inner[c] for c in word[:-1]]
        ids.append(self.last[word[-1]] if self.suffix else self.inner[word[-1]])
        return ids

    def merged(self, ids: list[int]) -> list[int]:
        """Merges by rank until none applies; among equal ranks from left to right."""
        rank, none = self.rank, len(self.made)
        while True:
            ranks = [rank.get(p, none) for p in zip(ids, ids[1:], strict=False)]
            best = min(ranks, default=none)
            if best == none:
                return ids
            token = self.made[best]
            if ranks.count(best) == 1:
                i = ranks.index(best)
                ids[i : i + 2] = (token,)
                continue
            out, i = [], 0
            while i < len(ids):
                if i < len(ranks) and ranks[i] == best:
                    out.append(token)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out

    def spelled(self, token: int) -> list[int]:
        """A token's symbols."""
        text = self.names[token]
        if self.suffix and text.endswith(self.suffix) and token in self.names and text[: -len(self.suffix)] in self.last:
            return self.atoms(text[: -len(self.suffix)])
        return [self.inner[c] for c in text]

    def follows(self, a: int, b: int) -> bool:
        """Whether b may stand after a: together they encode to themselves."""
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > KEPT_WORDS:
                self.fits.clear()
            found = self.fits[a, b] = self.merged(self.spelled(a) + self.spelled(b)) == [a, b]
        return found

    def stream(self, word: Iterator[str]) -> Iterator[int]:
        """The tokens of a word of any length, each as soon as no later symbol can change it.

        The window has, for the word so far (``at`` symbols) and each of its last ``lookahead`` ends, the
        tokens not yet emitted of the encoding up to that end.
        """
        width = self.lookahead
        recent = ""
        ends: list[tuple[int, ...] | None] = [()]  # encodings not yet emitted, by end; the last is the present end
        held = next(word, None)
        at = 0
        before = -1  # the token emitted last
        while held is not None:
            after = next(word, None)
            recent = (recent + held)[-width:]
            at += 1
            vocab = self.last if after is None and self.suffix else self.inner
            found = None
            for size in range(min(len(recent), len(ends)), 0, -1):
                token = vocab.get(recent[-size:])
                start = ends[-size]
                if token is None or start is None:
                    continue
                left = start[-1] if start else before
                if left < 0 or self.follows(left, token):
                    found = (*start, token)
                    break
            ends.append(found)
            ends = ends[-width:] if after is not None else [found]
            live = [e for e in ends if e is not None]
            agreed = 0
            while all(len(e) > agreed for e in live) and len({e[agreed] for e in live}) == 1:
                agreed += 1
            if agreed and (after is None or len(ends) == width):
                yield from live[0][:agreed]
                before = live[0][agreed - 1]
                ends = [None if e is None else e[agreed:] for e in ends]
            held = after

    def word(self, word: str) -> list[int]:
        """The tokens of one word of symbols."""
        return self.merged(self.atoms(word)) if len(word) <= self.lookahead else list(self.stream(iter(word)))

    def pieces(self, text: str) -> Iterator[str | int]:
        """Normalised pieces of a text and, between them, its special tokens."""
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            yield from self._plain(text[at : m.start()])
            yield self.special[m.group()]
            at = m.end()
        yield from self._plain(text[at:])

    def _plain(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            to = at + PIECE
            if to < len(text):
                cut = max(text.rfind(" ", at + 1, to), text.rfind("\n", at + 1, to))
                to = cut if cut > at else min((x for x in (text.find(" ", to), text.find("\n", to)) if x >= 0), default=len(text))
            part = text[at:to]
            if not part.isascii():
                if not unicodedata.is_normalized("NFC", part):
                    part = normalizers.NFC().normalize_str(part)
                part = part.replace("Σ", "σ")
            yield part.lower()
            at = to

    def merged_together(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that fit into the window: all of them are merged at once, one merge a word and round.

        A round finds each word's lowest rank among its pairs and applies that merge, from left to right, in every
        word; words without a pair to merge are done.
        """
        out = [b""] * len(words)
        lens = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = self.by_byte[data, 0]
        ids[np.cumsum(lens) - 1] = self.by_byte[data[np.cumsum(lens) - 1], 1]
        who = np.arange(len(words))
        while len(who):
            ends = np.cumsum(lens)
            starts = ends - lens
            rank = np.full(len(ids), self.ranks.none, np.int64)
            rank[:-1] = self.ranks.of(ids[:-1], ids[1:])
            rank[ends - 1] = self.ranks.none
            best = np.minimum.reduceat(rank, starts)
            done = best == self.ranks.none
            if done.any():
                raw = ids.astype("<u4").tobytes()
                for k, a, b in zip(who[done].tolist(), starts[done].tolist(), ends[done].tolist(), strict=True):
                    out[k] = raw[4 * a : 4 * b]
                stay = np.repeat(~done, lens)
                ids, rank = ids[stay], rank[stay]
                who, lens, best = who[~done], lens[~done], best[~done]
                if not len(who):
                    break
                starts = np.cumsum(lens) - lens
            hit = rank == np.repeat(best, lens)
            # of overlapping pairs of one symbol every other one is merged
            first = hit.copy()
            first[1:] &= ~hit[:-1]
            place = np.arange(len(ids))
            hit &= (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
            ids[hit] = self.made_ids[rank[hit]]
            gone = np.zeros(len(ids), bool)
            gone[1:] = hit[:-1]
            lens = lens - np.add.reduceat(hit, starts, dtype=np.int64)
            ids = ids[~gone]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encodes blank-separated pieces that are not known yet."""
        parts: dict[str, list[str]] = {}
        words: dict[str, bytes] = {}
        for piece in pieces:
            found = self.older.get(piece)
            if found is not None:
                self.known[piece] = found
                continue
            own = parts[piece] = WORD.findall(piece)
            for w in own:
                if w not in self.known and w not in words:
                    before = self.older.get(w)
                    if before is None:
                        words[w] = b""
                    else:
                        self.known[w] = before
        raws = {w: w.encode() for w in words}
        short = [w for w, r in raws.items() if len(r) <= self.lookahead]
        if short:
            words |= dict(zip(short, self.merged_together([raws[w] for w in short]), strict=True))
        for w, r in raws.items():
            if len(r) > self.lookahead:
                ids = list(self.stream(self.table[b] for b in r))
                words[w] = struct.pack(f"<{len(ids)}I", *ids)
        self.known |= words
        for piece, own in parts.items():
            if own != [piece]:
                self.known[piece] = b"".join([self.known[w] for w in own])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str] | bytes]] = []
        size = 0

        def settle() -> None:
            if len(self.known) > KEPT_WORDS:
                self.older, self.known = self.known, {}
            fresh: set[str] = set()
            for _, unit in held:
                if isinstance(unit, list):
                    fresh.update(unit)
            fresh.difference_update(self.known)
            self.learn(fresh)
            known = self.known
            for k, unit in held:
                out[k].append(unit if isinstance(unit, bytes) else b"".join([known[w] for w in unit]))
            for piece in [w for w in fresh if len(w) > self.lookahead]:
                del known[piece]
            held.clear()

        for k, text in enumerate(texts):
            for piece in self.pieces(text):
                if isinstance(piece, int):
                    held.append((k, struct.pack("<I", piece)))
                    continue
                held.append((k, [w for w in piece.replace("\n", " ").split(" ") if w]))
                size += len(piece)
                if size >= PIECE:
                    settle()
                    size = 0
        settle()
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> tuple[bytes, str]:
        """A text's ids and its decoded form."""
        (raw,) = self.encode_all([text])
        return raw, self.decode(unpacked(raw))

    def decode(self, ids: list[int]) -> str:
        """As the library decodes where a file names no decoder: the tokens as they are named, with blanks between them."""
        return "".join(self.decoder(False).run(ids))[1:]

    def plain(self, ids: list[int]) -> str:
        """The text that the tokens spell, with a blank after each word."""
        return "".join(self.decoder(True).run(ids))

    def decoder(self, spelled: bool) -> Decoder:
        """A state machine over the bytes of the tokens' names, or of what they spell."""
        if spelled not in self.byte_tables:
            back = {c: b for b, c in self.symbols.items()}
            own = set(self.special.values())

            def bytes_of(i: int, name: str) -> bytes:
                if not spelled:
                    return b" " + name.encode()
                if i in own:
                    return name.encode()
                ended = bool(self.suffix) and name.endswith(self.suffix)
                return bytes(back[c] for c in (name[: -len(self.suffix)] if ended else name)) + b" " * ended

            self.byte_tables[spelled] = [bytes_of(i, self.names.get(i, "")) for i in range(max(self.names) + 1)]
        return Decoder(self.byte_tables[spelled])


class Decoder:
    """An incremental byte-to-text machine: tokens go in, text comes out; its state is the bytes of a character that has not ended."""

    #: Tokens that are turned into bytes at once.
    STEP = 1 << 14

    def __init__(self, table: list[bytes]) -> None:
        self.table = table
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        table = self.table
        return self.state.decode(b"".join([table[i] for i in ids]))

    def end(self) -> str:
        return self.state.decode(b"", True)

    def run(self, ids: list[int]) -> Iterator[str]:
        for at in range(0, len(ids), self.STEP):
            yield self.feed(ids[at : at + self.STEP])
        yield self.end()


class PairTable:
    """Ranks of pairs of ids, looked up for whole arrays: open addressing in a table of 2^18 cells."""

    BITS = 18

    def __init__(self, rank: dict[tuple[int, int], int]) -> None:
        self.none = len(rank)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.values = np.full(1 << self.BITS, self.none, np.int64)
        for (a, b), n in rank.items():
            key = (a << 20) | b
            at = self._home(np.array([key]))[0]
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.BITS) - 1)
            self.keys[at], self.values[at] = key, n

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = self._home(key)
        out = self.values[at]
        held = self.keys[at]
        left = np.flatnonzero((held != key) & (held >= 0))
        out[(held != key)] = self.none
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[at[left]]
            match = held == key[left]
            out[left[match]] = self.values[at[left[match]]]
            left = left[~match & (held >= 0)]
        return out


def unpacked(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


_loaded: dict[int, Bpe] = {}


def loaded(source: str) -> Bpe:
    """The tokenizer of a file's text, made once by each worker."""
    key = hash(source)
    if key not in _loaded:
        _loaded[key] = Bpe(source)
    return _loaded[key]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (the tokens' names) and plain (what they spell) of every row; ``path`` names the tokenizer file on the driver."""
    shipped(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = bpe.encode_all([t or "" for t in part.column(1).to_pylist()])
                lists = [unpacked(x) for x in found]
                shown, plain = pa.array([bpe.decode(x) for x in lists], pa.string()), pa.array([bpe.plain(x) for x in lists], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary()), shown, plain], ["doc_id", "ids", "decoded", "plain"])

    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, ids binary, decoded string, plain string")
