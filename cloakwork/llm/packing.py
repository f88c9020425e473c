"""Best-fit packing of token sequences, after Martello and Toth's dominance reduction.

A document is its token ids and one end id. Documents of more than ``capacity`` tokens are cut into
pieces of that length, the remainder first; all others are one piece. Pieces go into as few sequences
of at most ``capacity`` tokens as the method finds.

How many pieces there are of each length is all that the packing depends on, and that is one number per
length, ``capacity`` at most, whatever the size of the table. On these counts the reduction fixes
sequences that some best packing has (:func:`reduce_counts`); the rest is packed by best fit, longest
pieces first, a class of equal pieces at a time (:func:`best_fit`). The result is a list of patterns
(which lengths a sequence holds, how many such sequences), a few per length. Every piece is numbered
among the pieces of its length, by task and place in it, and the number alone says which sequence it is
in and where. Neither documents nor sequences are ever gathered.

Ids are those of the ``tokenizers`` library for the given file. For a byte-level file without additions
the same ids are computed from the same merges by ``tiktoken``, which takes a fifth of the time; texts
that hold an added token's string or a very long run of white space always go through ``tokenizers``.

NULL counts as an empty text, which is the end id alone. Every row is a document of its own, repeated
rows and rows without an id too. An empty table gives no rows. Columns of the table other than id and
text are left out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import stored
from .common import column, text_steps

CAPACITY = 2048
END_ID = 0
#: Bytes of text that are encoded at once.
_STEP = 1 << 20
#: White space runs of this length go through ``tokenizers``: the other library's patterns fail on much longer ones.
_LONG_SPACE = re.compile(r"\s{5000}")
#: Split pattern of a byte-level file's own splitting (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- token ids -----------------------------------------------------------------------------------


def byte_ranks(definition: dict) -> dict[bytes, int] | None:
    """Bytes and ids of a plain byte-level vocabulary, whose ids follow its merges; None for any other file."""
    model, before = definition.get("model", {}), definition.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not any(definition.get(part) for part in ("normalizer", "truncation", "padding"))
        and not any(
            model.get(part)
            for part in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
    )
    if not plain:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {token["content"] for token in definition.get("added_tokens", [])}
    vocabulary = {token: i for token, i in model["vocab"].items() if token not in added}
    if any(char not in letters for token in vocabulary for char in token):
        return None
    pairs = (merge.split(" ") if isinstance(merge, str) else merge for merge in model["merges"])
    made = ["".join(pair) for pair in pairs]
    ids = [vocabulary.get(token) for token in made]
    singles = len(vocabulary) - len(made)
    if singles != 256 or ids != list(range(256, 256 + len(made))):
        return None
    return {bytes(letters[char] for char in token): i for token, i in vocabulary.items()}


class Encoder:
    """Ids of texts by a tokenizer file's content."""

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        definition = json.loads(content)
        self.library = Tokenizer.from_str(content)
        self.added = [token["content"] for token in definition.get("added_tokens", [])]
        ranks = byte_ranks(definition)
        self.fast = ranks and tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if not self.fast or any(token in text for token in self.added) or _LONG_SPACE.search(text):
            return self.by_library(text)
        return self.fast.encode_ordinary(text)


_encoders: dict[int, Encoder] = {}


def encode_pieces(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    text: str = "text",
    doc_id: str = "doc_id",
    ids: bool = True,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, the place ``task, at``, and with ``ids`` the ids themselves.

    ``tokenizer`` is the path of a ``tokenizers`` file. ``at`` numbers a task's pieces of one length;
    both hold only for rows that have been written.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    sent = docs.sparkSession.sparkContext.broadcast(content)  # a file of some megabytes
    key = zlib.crc32(content.encode())
    source = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    fields = [
        source.schema.fields[0],
        *[T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32")],
        T.StructField("task", T.IntegerType()),
        T.StructField("at", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if ids else []),
    ]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(sent.value)
        encoder = _encoders[key]
        task = TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for start, stop in text_steps(batch.column(1), _STEP):
                rows: list[tuple] = []
                for i in range(start, stop):
                    whole = np.array([*encoder(batch.column(1)[i].as_py() or ""), end_id], "<u4")
                    first = len(whole) % capacity or capacity
                    edges = [0, *range(first, len(whole) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                        data = whole[a:b].tobytes()
                        rows.append((i, piece, a, b - a, zlib.crc32(data), task, int(used[b - a]), data))
                        used[b - a] += 1
                at, *columns = zip(*rows)
                arrays = [batch.column(0).take(pa.array(at))]
                arrays += [pa.array(values, pa.int32() if n == "task" else pa.int64()) for n, values in zip(names[1:7], columns)]
                if ids:
                    arrays.append(pa.array(columns[6], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, T.StructType(fields))


# --- packing of counts ---------------------------------------------------------------------------

#: Lengths of a sequence's pieces, longest first, as (length, how many), and the number of such sequences.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def dominating_set(counts: np.ndarray, longest: int, capacity: int) -> tuple[int, ...] | None:
    """Up to three lengths, ``longest`` first, that some best packing has together in one sequence.

    A set F with the piece j dominates when every other set with j that fits can be exchanged for F: the
    others of that set go, in groups, to the places of F's pieces, each group no longer than the piece
    whose place it takes. Let a be the longest other piece that fits beside j. Then F is

    * j alone, if nothing fits beside it;
    * j and a, if a fills the sequence, if no two others fit beside j, or if at most two others fit and no
      two that fit are together longer than a;
    * j, a and b, with b the longest that fits beside both, if at most two others fit beside j and two
      pieces longer than b never fit with a sum above a: of any two that fit, the longer then goes to
      the place of a and the shorter to that of b, or both to that of a.
    """
    others = counts.copy()
    others[longest] -= 1
    room = capacity - longest
    lengths = np.flatnonzero(others[: room + 1])
    if not len(lengths):
        return (longest,)
    a = int(lengths[-1])
    if a == room:
        return (longest, a)
    least = [int(x) for x in np.repeat(lengths[:3], np.minimum(others[lengths[:3]], 3))[:3]]
    if len(least) < 2 or sum(least[:2]) > room:
        return (longest, a)
    if len(least) == 3 and sum(least) <= room:
        return None
    if _longest_pair(others, lengths, room) <= a:
        return (longest, a)
    others[a] -= 1
    beside = np.flatnonzero(others[: room - a + 1])
    others[a] += 1
    if not len(beside):
        return None
    b = int(beside[-1])
    return (longest, a, b) if _longest_pair(others, lengths[lengths > b], room) <= a else None


def _longest_pair(counts: np.ndarray, lengths: np.ndarray, room: int) -> int:
    """Greatest sum of two pieces of the given lengths that is at most ``room``; 0 if there is none."""
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        both = int(lengths[low] + lengths[high])
        if both > room or (low == high and counts[lengths[low]] < 2):
            high -= 1
        else:
            best, low = max(best, both), low + 1
    return best


def reduce_counts(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[Pattern], np.ndarray]:
    """Sequences that some best packing has, and the counts that are left.

    What dominates keeps dominating while all of its pieces last, as the sets it is compared with only
    become fewer; so it is fixed as often as its lengths occur. Ends when a pass over all lengths fixes
    nothing more.
    """
    counts, fixed, found = counts.copy(), [], True
    while found:
        found = False
        for length in range(capacity, 0, -1):
            while counts[length] and (chosen := dominating_set(counts, length, capacity)):
                kinds = [(x, chosen.count(x)) for x in dict.fromkeys(chosen)]
                times = min(int(counts[x]) // many for x, many in kinds)
                for x, many in kinds:
                    counts[x] -= many * times
                fixed.append((tuple(kinds), times))
                found = True
    return fixed, counts


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit of pieces in falling length: each goes where the least room is left, else to a new sequence.

    Pieces of one length that go to equal sequences are handled together.
    """
    open_: dict[int, list[Pattern]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            rooms = [room for room in open_ if room >= length]
            room = min(rooms, default=capacity)
            pattern, bins = open_[room].pop() if rooms else ((), -(-left // (capacity // length)))
            if rooms and not open_[room]:
                del open_[room]
            each = room // length  # less and less room: the next one goes to the same sequence
            full = min(bins, left // each)
            last = min(left - full * each, each) if full < bins else 0
            for many, times in ((each, full), (last, 1 if last else 0), (0, bins - full - (1 if last else 0))):
                if times:
                    new = pattern + ((length, many),) if many else pattern
                    open_.setdefault(room - many * length, []).append((new, times))
            left -= full * each + last
    return [group for groups in open_.values() for group in groups]


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go: runs of pieces, in order of length and number."""

    patterns: list[Pattern]
    base: np.ndarray  # by length: the number that its first piece has among all pieces
    first: np.ndarray  # by run: its first piece, its pieces per sequence, sequence and offset to begin with
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @property
    def n_sequences(self) -> int:
        return sum(times for _, times in self.patterns)


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    fixed, left = reduce_counts(counts, capacity)
    patterns = fixed + best_fit(left, capacity)
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])
    runs, sequence, taken = [], 0, base.copy()
    for kinds, times in patterns:
        offset = 0
        for length, many in kinds:
            runs.append((int(taken[length]), many, sequence, offset))
            taken[length] += many * times
            offset += many * length
        sequence += times
    runs.sort()
    return Plan(patterns, base, *np.array(runs, np.int64).reshape(-1, 4).T)


# --- the operator --------------------------------------------------------------------------------


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    text: str = "text",
    doc_id: str = "doc_id",
    ids: bool = True,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces, with ``ids`` if asked for."""
    coded = encode_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, text=text, doc_id=doc_id, ids=ids)
    pieces = stored(coded, "pieces")
    of_tasks = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in of_tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length
        counts[row.length] = row.n
    plan = plan_packing(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = pieces.join(starts, ["task", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    placed = numbered.select(*names, (F.col("_before") + F.col("at")).alias("number"))
    new = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return placed.mapInArrow(_placing(plan, len(names)), T.StructType(placed.schema.fields[:-1] + new))


def _placing(plan: Plan, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"))
            number = plan.base[length] + np.asarray(batch.column(last))
            at = np.searchsorted(plan.first, number, side="right") - 1
            inside = number - plan.first[at]
            sequence = plan.sequence[at] + inside // plan.each[at]
            offset = plan.offset[at] + inside % plan.each[at] * length
            arrays = [*batch.columns[:last], pa.array(sequence), pa.array(offset)]
            names = [*batch.schema.names[:last], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, n_tokens, doc_ids``: the sequences themselves, documents in order of their offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))  # at most ``capacity`` pieces
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return whole.select(
        "sequence_id",
        joined.alias("ids"),
        (F.octet_length(joined) / 4).cast("long").alias("n_tokens"),
        F.transform("parts", lambda part: part["doc_id"]).alias("doc_ids"),
    )
