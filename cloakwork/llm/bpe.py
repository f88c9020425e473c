"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

A vocabulary file gives every token's bytes a rank, which is its id. A text is cut into pre-tokens
by a pattern. A pre-token that is itself in the vocabulary is looked up in a minimal perfect hash;
any other one starts as a list of single bytes, and a heap gives the neighbours of lowest rank
(leftmost first) to join until no neighbours are in the vocabulary. There are no special tokens.

NULL and empty texts have no ids. Every text is encoded whole, whatever its length. Columns that
have the name of a result column are replaced; all others stay as they are.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import re
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import STEP_BYTES, add_columns

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters up to here get a pattern of the standard library, which is faster than Unicode classes.
_NEAR = 0x24F
#: Bytes, roughly, of encoded pre-tokens that a worker remembers, twice over, before it forgets the older
#: half; longer pre-tokens are not remembered. Results do not depend on it.
_REMEMBERED = 64 << 20
_LONGEST_REMEMBERED = 64
#: What a remembered pre-token takes besides its bytes.
_ENTRY = 250


def byte_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings that begin at ``starts`` and fill ``data``; none is empty."""
    sizes = np.diff(np.append(starts, len(data)))
    within = np.arange(len(data)) - np.repeat(starts, sizes)
    powers = np.ones(int(sizes.max(initial=1)), np.uint64)
    powers[1:] = np.uint64(0x100000001B3)
    np.multiply.accumulate(powers, out=powers)
    hashes = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[within], starts)
    hashes ^= sizes.astype(np.uint64) * _MIX
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return hashes ^ (hashes >> np.uint64(29))


def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    mixed = (hashes ^ (shift.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * _MIX
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """A minimal perfect hash: ``n`` keys on ``n`` places, by one displacement for each bucket.

    A bucket of several keys stores the shift that puts them on free places; a bucket of one key
    stores its place, as a negative number.
    """

    shifts: np.ndarray
    n: int

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        if len(np.unique(hashes)) < n:
            raise ValueError("Two keys have the same hash")
        buckets = (hashes % np.uint64(max(1, n // 3))).astype(np.int64)
        shifts, free = np.zeros(max(1, n // 3), np.int64), np.ones(n, bool)
        order = np.argsort(buckets, kind="stable")
        bounds = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=-2))
        members = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        members.sort(key=len, reverse=True)
        singles = []
        for keys in members:
            if len(keys) == 1:
                singles.append(keys[0])
                continue
            first = 1
            while True:
                tries = np.arange(first, first + 256)
                places = np.sort(_slots(hashes[keys][None, :], tries[:, None], n), axis=1)
                good = free[places].all(1) & (np.diff(places, axis=1) > 0).all(1)
                if good.any():
                    chosen = int(np.argmax(good))
                    shifts[buckets[keys[0]]] = tries[chosen]
                    free[places[chosen]] = False
                    break
                first += 256
        shifts[buckets[singles]] = -1 - np.flatnonzero(free)
        return cls(shifts, n)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        shift = self.shifts[(hashes % np.uint64(len(self.shifts))).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, _slots(hashes, shift, self.n))


def _near_pattern(pattern: str) -> re.Pattern:
    """The pattern with its Unicode classes written out, right for characters up to ``_NEAR``."""

    def listed(name: str) -> str:
        found = regex.compile(rf"\p{{{name}}}")
        return "".join(re.escape(chr(c)) for c in range(_NEAR + 1) if found.match(chr(c)))

    space = regex.compile(r"\s")
    spaces = "".join(rf"\x{c:02x}" for c in range(_NEAR + 1) if space.match(chr(c)))
    plain = pattern.replace(r"\S", f"[^{spaces}]").replace(r"[^\s", f"[^{spaces}")
    plain = re.sub(r"(?<!\[\^)\\s", lambda _: f"[{spaces}]", plain)
    for name in ("L", "N"):
        inside = re.compile(rf"(\[[^\]]*)\\p\{{{name}\}}")
        plain = inside.sub(lambda m: m[1] + listed(name), plain)
        plain = plain.replace(rf"\p{{{name}}}", f"[{listed(name)}]")
    return re.compile(plain)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of a rank file (base64 of a token, space, rank) and the pattern of its pre-tokens."""

    tokens: list[bytes]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            ranks = {int(b): base64.b64decode(a) for a, b in (x.split() for x in lines if x.strip())}
        return cls([ranks[i] for i in range(len(ranks))], pattern)

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {token: rank for rank, token in enumerate(self.tokens)}

    @cached_property
    def hashed(self) -> tuple[PerfectHash, np.ndarray]:
        """The perfect hash, and the rank of the key at each place."""
        hashes = byte_hashes(*_joined(self.tokens))
        table = PerfectHash.build(hashes)
        ranks = np.empty(len(hashes), np.int64)
        ranks[table.places(hashes)] = np.arange(len(hashes))
        return table, ranks


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: neighbours of lowest rank are joined first, leftmost at equal rank."""
    n = len(piece)
    ends = list(range(1, n + 1))  # where the part that begins here ends; 0: it is part of another
    before = list(range(-1, n))
    rank, m = ranks.get, n + 1  # a heap entry: rank, start and end in one number
    pairs = [rank(piece[i : i + 2]) for i in range(n - 1)]
    heap = [(r * n + i) * m + i + 2 for i, r in enumerate(pairs) if r is not None]
    heapify(heap)
    while heap:
        entry, end = divmod(heappop(heap), m)
        i = entry % n
        j = ends[i]
        if not j or j >= n or ends[j] != end:
            continue
        ends[i], ends[j] = end, 0
        if end < n:
            before[end] = i
            if (r := rank(piece[i : ends[end]])) is not None:
                heappush(heap, (r * n + i) * m + ends[end])
        if i:
            left = before[i]
            if (r := rank(piece[left:end])) is not None:
                heappush(heap, (r * n + left) * m + end)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return ids


class Encoder:
    """Encodes batches of texts; each distinct pre-token of a batch is looked up once."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks, (self.table, self.at) = vocabulary.ranks, vocabulary.hashed
        self.tokens = vocabulary.tokens
        self.pattern, self.near = regex.compile(vocabulary.pattern), _near_pattern(vocabulary.pattern)
        self.far = re.compile(f"[^\\x00-{chr(_NEAR)}]").search
        self.recent: dict[bytes, list[int]] = {}
        self.older: dict[bytes, list[int]] = {}
        self.size = 0

    def pieces(self, text: str) -> list[str]:
        return (self.pattern if self.far(text) else self.near).findall(text)

    def lookup(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of distinct, non-empty pre-tokens."""
        ranks = self.at[self.table.places(byte_hashes(*_joined(pieces)))].tolist()
        tokens, recent, older, found = self.tokens, self.recent, self.older, []
        for piece, r in zip(pieces, ranks):
            if tokens[r] == piece:
                found.append([r])
                continue
            ids = recent.get(piece)
            if ids is None:
                ids = older.get(piece) or merge(piece, self.ranks)
                if len(piece) <= _LONGEST_REMEMBERED:
                    recent[piece] = ids
                    self.size += len(piece) + _ENTRY
                    if self.size > _REMEMBERED:
                        older, recent, self.size = recent, {}, 0
            found.append(ids)
        self.recent, self.older = recent, older
        return found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin and end."""
        pieces = [self.pieces(text) if text else [] for text in texts]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.empty(int(counts.sum()), object)
        flat[:] = list(chain.from_iterable(pieces))
        ends = np.concatenate([[0], np.cumsum(counts)])
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        codes, distinct = pd.factorize(flat)
        ids = self.lookup([piece.encode() for piece in distinct])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.cumsum(sizes) - sizes
        table = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        lengths = sizes[codes]
        done = np.concatenate([[0], np.cumsum(lengths)])
        where = np.repeat(starts[codes] - done[:-1], lengths) + np.arange(done[-1])
        return table[where], done[ends]


_encoders: dict[str, Encoder] = {}


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(np.ascontiguousarray(offsets, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) // 4 - 1, [None, offsets, pa.py_buffer(data)])


def encode_texts(
    df: DataFrame,
    vocabulary: Vocabulary,
    text: str = "text",
    drop: bool = False,
    decode: bool = False,
    check: bool = False,
    step: int = STEP_BYTES * 2,
) -> DataFrame:
    """``df`` with ``ids``: the token ids as little-endian unsigned 32-bit integers, one binary value.

    ``drop`` leaves the texts out of the result. ``decode`` adds ``decoded`` as :func:`decode_ids` does,
    in the same pass, ``check`` the boolean ``round_trip``: whether the decoded bytes are the text's. ``step``
    is how many bytes of text a worker handles at once.
    """
    vocabulary.hashed  # built once, here; workers get it with the vocabulary
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    key = f"{vocabulary.pattern} {hash(tuple(vocabulary.tokens))}"

    def compute(texts: pa.Array) -> list[pa.Array]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(sent.value)
        encoder = _encoders[key]
        ids, places = encoder.encode(texts.to_pylist())
        packed = _binary(ids.astype("<u4").tobytes(), places * 4)
        new = [packed]
        if decode or check:
            back = _decoded(packed, encoder.tokens)
            new += [back] if decode else []
            new += [pc.equal(back, pc.fill_null(texts, "").cast(pa.binary()))] if check else []
        return new

    fields = [T.StructField(n, T.BinaryType()) for n in (["ids", "decoded"] if decode else ["ids"])]
    fields += [T.StructField("round_trip", T.BooleanType())] if check else []
    return add_columns(df, text, fields, compute, step, drop)


def _decoded(packed: pa.Array, tokens: list[bytes]) -> pa.Array:
    numbers = (np.frombuffer(one.as_buffer() or b"", "<u4").tolist() if one.is_valid else [] for one in packed)
    return pa.array([b"".join([tokens[i] for i in row]) for row in numbers], pa.binary())


def decode_ids(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the bytes of the tokens in ``ids``, joined. NULL has none.

    An id outside the vocabulary is an error: it cannot stand for any bytes.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    def compute(packed: pa.Array) -> list[pa.Array]:
        return [_decoded(packed, sent.value)]

    return add_columns(df, ids, [T.StructField("decoded", T.BinaryType())], compute)
