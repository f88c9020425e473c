"""Removing repeated byte strings with suffix arrays.

A byte is removed if it is covered by a string of ``length`` bytes that also starts anywhere else in
the corpus, the same document included. Strings never cross documents and are judged on the input.

1. Every window of ``length`` bytes has a mark: the smallest hash of the strings of a third of its
   length inside it (so what is shared by less than that has no mark in common). Equal windows have
   equal marks. Neighbouring windows with one mark form a stretch, so a document has about one
   stretch for every 130 bytes. Only digests of stretches are shuffled.
2. Stretches whose mark occurs nowhere else are clean. A stretch that occurs twice as a whole is
   repeated as a whole. What is left, mostly the ends of shared passages, goes to shards by its mark.
3. A shard sorts its suffixes by Larsson-Sadakane refinement, as far as their first ``length`` bytes
   decide; windows that these do not set apart are repeated.
4. A mark that many stretches have is dealt over several shards. Each of these also writes the
   digests of its windows as sorted runs, cut by digest ranges; the runs of a range are merged by
   binary search, and windows found in two shards are repeated.

``remove_repeats`` can remove repeated passages of a number of words as well, whatever bytes they have.
These are searched in the same way, in texts whose words are replaced by codes of ``_CODE`` bytes.
Words are what stands between white space; equal codes are taken for equal words (35-bit hashes, of
which all in a passage have to agree). White space inside a passage may differ.

NULL is an empty text. Rows with equal texts are copies of each other, whatever their other columns
hold. Columns named like result columns are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import STEP_BYTES, column, kept_columns, text_bytes, text_steps

LENGTH = 400
#: Bytes of stretches in one shard.
SHARD_BYTES = 1 << 20
#: Stretches of one mark in one shard; a mark with more is dealt over several.
SHARD_STRETCHES = 128
#: Window digests in one merge.
MERGE_WINDOWS = 1 << 18
#: Windows of one stretch: repetitive texts have long ones, which would hold up the other strings.
_LONGEST = 512
#: Bytes, of seven bits each, that stand for a word.
_CODE = 5
#: Windows of a text that are looked at in one step.
_STEP_WINDOWS = 4 << 20
#: Bytes of text whose words are coded at once, which takes 35 times their memory; a longer text is coded whole.
_STEP_CODED = 1 << 19

_STRETCH = "key binary, mark long, digest binary, start long, stop long, weight int"


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; equal for equal texts only."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed 64-bit hashes of all strings of ``size`` bytes."""
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(base), -1, 1 << 64))
    powers, backs = np.full(len(data), base), np.full(len(data), back)
    powers[0] = backs[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(backs, out=backs)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    hashes = (sums[size:] - sums[:-size]) * backs[: len(data) - size + 1]
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, places: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``text, mark, start, stop, weight``: the stretches of all texts.

    ``start`` and ``stop`` are the first and last window, counted from the text's begin; a weight of
    2 says that the mark's string occurs more than once inside.
    """
    if len(data) < length:
        return
    gram = max(1, length // 3)
    grams = gram_hashes(data, gram)
    width = length - gram + 1
    marks = sliding_minimum(grams, width)
    owner = np.searchsorted(places, np.arange(len(marks)), side="right") - 1
    owner[np.arange(len(marks)) + length > places[owner + 1]] = -1
    edges = np.flatnonzero((np.diff(marks) != 0) | (np.diff(owner) != 0)) + 1
    firsts = np.concatenate([[0], edges])
    lasts = np.concatenate([edges, [len(marks)]]) - 1
    for first, last in _pieces(firsts.tolist(), lasts.tolist()):
        text = int(owner[first])
        if text >= 0:
            mark = marks[first]
            weight = min(2, int(np.count_nonzero(grams[first : last + width] == mark)))
            begin = int(places[text])
            yield text, int(mark.view(np.int64)), first - begin, last - begin, weight


def _pieces(firsts: list[int], lasts: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``_LONGEST`` windows."""
    for first, last in zip(firsts, lasts):
        for cut in range(first, last + 1, _LONGEST):
            yield cut, min(cut + _LONGEST - 1, last)


def _find_stretches(docs: DataFrame, length: int) -> DataFrame:
    """Rows ``_STRETCH`` of the texts in column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_steps(batch.column(0)):
                data, places = text_bytes(batch.column(0).slice(start, stop - start))
                raw = data.tobytes()
                keys = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(places[:-1], places[1:])]
                rows = []
                for cut in range(0, max(1, len(data)), _STEP_WINDOWS):  # a long text in several steps
                    whole = len(data) <= _STEP_WINDOWS
                    piece = data if whole else data[cut : cut + _STEP_WINDOWS + length - 1]
                    ends = places if whole else np.clip(places - cut, 0, len(piece))
                    for text, mark, first, last, weight in stretches(piece, ends, length):
                        at = int(ends[text]) + first
                        bytes_ = piece[at : at + last - first + length].tobytes()
                        shift = max(0, cut - int(places[text]))
                        digest = hashlib.blake2b(bytes_, digest_size=16).digest()
                        rows.append((keys[text], mark, digest, first + shift, last + shift, weight))
                    if whole:
                        break
                yield _batch(rows, _STRETCH)

    return docs.select("text").mapInArrow(run, _STRETCH)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [part.strip().split(" ") for part in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def sorted_suffixes(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order of their first ``depth`` bytes, and where a group of equal ones begins.

    ``ends`` has, for every byte, where its string ends; a suffix stops there, and sorts before its
    extensions. Refinement: suffixes with equal first ``h`` bytes are one group; the groups of what
    follows ``h`` bytes later order each group by ``2 h`` bytes. Groups of one are left alone.
    """
    n = len(data)
    h = max(1, min(7, depth))
    symbols = np.concatenate([data.astype(np.int64) + 1, np.zeros(h, np.int64)])
    left = ends - np.arange(n)
    value = np.zeros(n, np.int64)
    for i in range(h):  # seven symbols of nine bits; 0 stands for the end
        value = (value << 9) | symbols[i : i + n]
    short = np.flatnonzero(left < h)
    value[short] &= ~((1 << (9 * (h - left[short]))) - 1)
    order = np.argsort(value)
    value = value[order]
    changes = np.concatenate([[True], value[1:] != value[:-1]])
    group = np.empty(n, np.int64)
    group[order] = np.maximum.accumulate(np.where(changes, np.arange(n), 0))
    at = np.arange(n)
    while h < depth:
        alone = changes[at] & np.append(changes[1:], True)[at]  # groups of one are in their place
        at = at[~alone]
        if not len(at):
            break
        step = min(h, depth - h)
        suffixes = order[at]
        later = suffixes + step
        inside = later < ends[suffixes]
        following = np.where(inside, group[np.where(inside, later, 0)] + 1, 0)
        key = group[suffixes] * (n + 1) + following  # shards are small, so this fits
        by = np.argsort(key)
        suffixes, key = suffixes[by], key[by]
        order[at] = suffixes
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        changes[at[fresh]] = True
        group[suffixes] = np.maximum.accumulate(np.where(fresh, at, 0))
        h += step
    return order, changes


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, whether each of its windows also starts elsewhere in these strings."""
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    ends = np.repeat(stops, sizes)
    order, changes = sorted_suffixes(data, ends, length)
    found = np.zeros(len(data), bool)
    found[order[~(changes & np.append(changes[1:], True))]] = True  # one that ends earlier equals no window
    return [found[a : max(a, b - length + 1)] for a, b in zip(starts, stops)]


def _ranges(mask: np.ndarray) -> list[int]:
    """First and last place, one after the other, of each run of true values."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    edges[1::2] -= 1
    return edges.tolist()


_SHARD = "digest binary, ranges array<long>, part long, windows binary, owner long"


def _sort_shards(open_: DataFrame, length: int, parts: int) -> DataFrame:
    """Repeated windows inside each shard; and runs of window digests of shards with a shared mark.

    Rows with a ``digest`` hold ranges of windows of that stretch. Rows with a ``part`` hold a run:
    sorted 16-byte digests of the distinct windows in that range of digests.
    """
    size = min((1 << 64) // parts + 1, (1 << 64) - 1)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        digests = group.column("digest").to_pylist()
        strings = group.column("bytes").to_pylist()
        dealt = group.column("dealt")[0].as_py()
        rows: list[tuple] = []
        for digest, mask in zip(digests, repeated_windows(strings, length)):
            if mask.any():
                rows.append((digest, _ranges(mask), None, None, None))
        if dealt:
            runs = np.unique(np.concatenate([_window_digests(s, length) for s in strings]))
            part = (runs["a"] // np.uint64(size)).astype(np.int64)
            for p in np.unique(part).tolist():
                rows.append((None, None, p, runs[part == p].tobytes(), key[0].as_py()))
        return pa.Table.from_batches([_batch(rows, _SHARD)])

    return open_.groupBy("shard").applyInArrow(run, _SHARD)


_DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])


def _window_digests(string: bytes, length: int) -> np.ndarray:
    view = memoryview(string)
    made = [hashlib.blake2b(view[i : i + length], digest_size=16).digest() for i in range(len(string) - length + 1)]
    return np.frombuffer(b"".join(made), _DIGEST)


def _merge_runs(runs: DataFrame) -> DataFrame:
    """``owner, windows``: window digests of each shard that another shard has too."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        owners = group.column("owner").to_pylist()
        sorted_runs = [np.frombuffer(w, _DIGEST) for w in group.column("windows").to_pylist()]
        merged = np.concatenate(sorted_runs)
        merged = merged[np.lexsort((merged["b"], merged["a"]))]
        rows = []
        for owner, one in zip(owners, sorted_runs):  # a run has a digest once, so twice means two shards
            first = np.searchsorted(merged["a"], one["a"], side="left")
            last = np.searchsorted(merged["a"], one["a"], side="right")
            twice = last - first > 1
            for i in np.flatnonzero(twice):
                twice[i] = np.count_nonzero(merged["b"][first[i] : last[i]] == one["b"][i]) > 1
            if twice.any():
                rows.append((owner, one[twice].tobytes()))
        return pa.Table.from_batches([_batch(rows, "owner long, windows binary")])

    return runs.groupBy("part").applyInArrow(run, "owner long, windows binary")


def _mark_merged(open_: DataFrame, merged: DataFrame, length: int) -> DataFrame:
    """``digest, ranges`` of windows in dealt shards that the merge found in another shard."""
    schema = "digest binary, ranges array<long>"

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.frombuffer(w, _DIGEST) for w in right.column("windows").to_pylist()]
        rows = []
        if found and left.num_rows:
            known = {x.tobytes() for x in np.concatenate(found)}
            for digest, string in zip(left.column("digest").to_pylist(), left.column("bytes").to_pylist()):
                mask = np.array([x.tobytes() in known for x in _window_digests(string, length)])
                if mask.any():
                    rows.append((digest, _ranges(mask)))
        return pa.Table.from_batches([_batch(rows, schema)])

    dealt = open_.where("dealt").groupBy("shard")
    return dealt.cogroup(merged.groupBy("owner")).applyInArrow(run, schema)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``key, spans``: for each distinct text with repeated windows, their first and last places.

    ``key`` is ``text_key`` of the text. Spans are not merged and in no order.
    """
    texts = docs.select(column(text).alias("text"))
    all_ = stored(_find_stretches(texts, length), "stretches")
    common = all_.groupBy("mark").agg(F.sum("weight").alias("n")).where("n > 1").select("mark")
    known = stored(all_.join(common, "mark"), "marked")

    first = F.min(F.struct("key", "start", "stop")).alias("at")
    kinds = known.groupBy("mark", "digest").agg(F.count("*").alias("n"), F.max("weight").alias("weight"), first)
    kinds = stored(kinds, "kinds")
    lone = (F.col("n") == 1).cast("int")
    size = F.col("at.stop") - F.col("at.start") + length
    marks = kinds.groupBy("mark").agg(
        F.max(lone).alias("lone"), F.count("*").alias("kinds"), F.max(F.col("weight") * lone).alias("weight"),
        F.sum(size).alias("bytes"),
    )
    marks = marks.where("lone = 1 AND (kinds > 1 OR weight > 1)").select("mark", "kinds", "bytes")
    wanted = kinds.select("mark", "digest", "at").join(marks, "mark")
    dealt = F.greatest(F.ceil(F.col("bytes") / SHARD_BYTES), F.ceil(F.col("kinds") / SHARD_STRETCHES))
    wanted = wanted.select(
        "digest", "at.*", "mark", dealt.cast("long").alias("shards")
    )
    wanted = stored(wanted, "open")
    total = wanted.agg(
        F.coalesce(F.sum(F.col("stop") - F.col("start") + length), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("shards") > 1, F.col("stop") - F.col("start") + 1)), F.lit(0)).alias("windows"),
    ).first()
    shards = max(1, -(-total["bytes"] // SHARD_BYTES))
    own = F.pmod(F.xxhash64("mark"), F.lit(shards))
    spread = F.xxhash64("mark", F.pmod(F.xxhash64("digest"), F.col("shards")))
    shard = F.when(F.col("shards") > 1, spread.bitwiseOR(F.lit(-(1 << 63)))).otherwise(own)
    pieces = _cut(texts, wanted.withColumn("shard", shard).withColumn("dealt", F.col("shards") > 1), length)
    pieces = stored(pieces, "pieces")
    parts = max(1, -(-total["windows"] // MERGE_WINDOWS))
    sorted_ = stored(_sort_shards(pieces, length, parts), "sorted")
    results = sorted_.where("digest IS NOT NULL").select("digest", "ranges")
    if total["windows"]:
        merged = _merge_runs(sorted_.where("part IS NOT NULL").select("part", "owner", "windows"))
        results = results.union(_mark_merged(pieces, merged, length))

    whole = known.join(kinds.where("n > 1").select("mark", "digest"), ["mark", "digest"])
    whole = whole.select("key", F.array(F.struct("start", "stop")).alias("spans"))
    spans = F.transform(
        F.sequence(F.lit(0), F.size("ranges") - 2, F.lit(2)),
        lambda i: F.struct(
            (F.col("start") + F.element_at("ranges", (i + 1).cast("int"))).alias("start"),
            (F.col("start") + F.element_at("ranges", (i + 2).cast("int"))).alias("stop"),
        ),
    )
    partly = wanted.select(F.col("key"), "start", "digest").join(results, "digest").select("key", spans.alias("spans"))
    return whole.union(partly).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))


_SPLIT = np.zeros(256, bool)
_SPLIT[[9, 10, 11, 12, 13, 32]] = True


def _word_places(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts start and stop."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPLIT[data]
    fresh, over = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    fresh[places], over[places] = True, True
    starts = np.flatnonzero(inside & (fresh[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stops = np.flatnonzero(inside & (over[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, stops


def _word_codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """``_CODE`` bytes below 128 for each word, one after the other."""
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(base), -1, 1 << 64))
    powers, backs = np.full(len(data), base), np.full(len(data), back)
    if len(data):
        powers[0] = backs[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(backs, out=backs)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * backs[starts] + (stops - starts).astype(np.uint64)
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    hashes ^= hashes >> np.uint64(31)
    shifts = np.arange(_CODE, dtype=np.uint64) * np.uint64(7)
    return ((hashes[:, None] >> shifts) & np.uint64(127)).astype(np.uint8).ravel()


def repeated_word_spans(docs: DataFrame, text: str, words: int) -> DataFrame:
    """``key, word_spans``: for each distinct text with repeated passages of ``words`` words, spans of first words.

    ``key`` is ``text_key`` of the text. Every passage that begins at a word from ``start`` to ``stop`` is repeated.
    The codes are written: the search reads them in Python too, and a task with two Python steps has two workers, which
    the executor keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_steps(batch.column(0), _STEP_CODED):
                data, places = text_bytes(batch.column(0).slice(start, stop - start))
                starts, stops = _word_places(data, places)
                codes = _word_codes(data, starts, stops).tobytes()
                ends = np.searchsorted(starts, places) * _CODE
                raw = data.tobytes()
                keys = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(places[:-1], places[1:])]
                coded = [codes[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                new = [pa.array(keys, pa.binary()), pa.array(coded, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(new, names=["key", "text"])

    coded = stored(docs.select(column(text).alias("text")).mapInArrow(run, "key binary, text string"), "word-codes")
    found = repeated_spans(coded, "text", words * _CODE).withColumnRenamed("key", "code_key")
    names = coded.select("key", text_key(F.col("text")).alias("code_key")).distinct()
    # windows that begin inside a word's code are none of words
    aligned = F.transform(
        "spans",
        lambda s: F.struct(
            F.ceil(s["start"] / _CODE).cast("long").alias("start"), F.floor(s["stop"] / _CODE).cast("long").alias("stop")
        ),
    )
    aligned = F.filter(aligned, lambda s: s["start"] <= s["stop"])
    return names.join(found, "code_key").select("key", aligned.alias("word_spans")).where(F.size("word_spans") > 0)


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``digest, shard, dealt, bytes``: the bytes of wanted stretches; one row each."""
    lists = wanted.groupBy("key").agg(
        F.collect_list(F.struct("digest", "start", "stop", "shard", "dealt")).alias("cuts")
    )
    keyed = texts.select(text_key(F.col("text")).alias("key"), "text")
    one = keyed.join(lists.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    rows = one.join(lists, "key").select(F.col("text").cast("binary").alias("text"), F.explode("cuts").alias("cut"))
    at, size = F.col("cut.start") + 1, F.col("cut.stop") - F.col("cut.start") + length
    cut = F.substring(F.col("text"), at.cast("int"), size.cast("int"))
    return rows.select("cut.digest", "cut.shard", "cut.dealt", cut.alias("bytes"))


_REMOVED = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField(
        "removed", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "stop")]))
    ),
]


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, drop: bool = False, as_text: bool = False,
    words: int | None = None,
) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that are left), ``n_bytes`` and ``removed``.

    ``removed`` has the maximal removed runs, as bytes ``start`` to before ``stop``. ``drop`` leaves
    the texts out. ``as_text`` gives ``kept`` as a string, without what is left of characters that a
    cut goes through. With ``words``, what lies in a passage of so many words that also starts
    anywhere else goes too, from its first word to its last.
    """
    fields = [T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *_REMOVED]
    spans = stored(repeated_spans(docs, text, length), "spans")
    kept = kept_columns(docs, [f.name for f in fields] + ([text] if drop else []))
    source = docs.select(*map(column, kept), F.coalesce(column(text), F.lit("")).alias("_text"))
    source = source.withColumn("_key", text_key(F.col("_text")))
    source = source.join(spans.select(F.col("key").alias("_key"), F.col("spans").alias("_spans")), "_key", "left")
    more = F.lit(None).cast("array<struct<start: bigint, stop: bigint>>").alias("_words")
    if words is not None:
        passages = stored(repeated_word_spans(docs, text, words), "passages")
        source = source.join(passages.select(F.col("key").alias("_key"), F.col("word_spans").alias("_words")), "_key", "left")
        more = F.col("_words")
    source = source.select(*map(column, kept), "_text", "_spans", more)
    n = len(kept)
    runs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = kept + [f.name for f in fields]
        for batch in batches:
            for start, stop in text_steps(batch.column(n), STEP_BYTES * 2):
                part = batch.slice(start, stop - start)
                data, places = text_bytes(part.column(n))
                left, removed = [], []
                for i, (spans, passages) in enumerate(zip(part.column(n + 1).to_pylist(), part.column(n + 2).to_pylist())):
                    one = data[places[i] : places[i + 1]]
                    merged = _merged(spans or [], length)
                    if passages:
                        starts, stops = _word_places(one, np.array([0, len(one)]))
                        cuts = [(int(starts[p["start"]]), int(stops[p["stop"] + words - 1])) for p in passages]
                        merged = _united([*((m["start"], m["stop"]) for m in merged), *cuts])
                    keep = np.ones(len(one), bool)
                    for span in merged:
                        keep[span["start"] : span["stop"]] = False
                    left.append(_joined_text(one, merged) if as_text else one[keep].tobytes())
                    removed.append(merged)
                new = [pa.array(left, pa.string() if as_text else pa.binary()), pa.array(np.diff(places), pa.int64()), pa.array(removed, runs)]
                yield pa.RecordBatch.from_arrays(part.columns[:n] + new, names=names)

    return source.mapInArrow(run, T.StructType(source.schema.fields[:n] + fields))


def _joined_text(data: np.ndarray, removed: list[dict]) -> str:
    edges = [0, *(x for span in removed for x in (span["start"], span["stop"])), len(data)]
    parts = [data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])]
    return "".join(part.decode(errors="ignore") for part in parts)


def _merged(spans: list[dict], length: int) -> list[dict]:
    merged: list[dict] = []
    for first, last in sorted((s["start"], s["stop"]) for s in spans):
        if merged and first <= merged[-1]["stop"]:
            merged[-1]["stop"] = max(merged[-1]["stop"], last + length)
        else:
            merged.append({"start": first, "stop": last + length})
    return merged


def _united(cuts: list[tuple[int, int]]) -> list[dict]:
    """Maximal runs of bytes that lie in ``cuts``."""
    united: list[dict] = []
    for start, stop in sorted(cuts):
        if united and start <= united[-1]["stop"]:
            united[-1]["stop"] = max(united[-1]["stop"], stop)
        else:
            united.append({"start": start, "stop": stop})
    return united
