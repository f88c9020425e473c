"""Documents linked by the Jaccard similarity of their word n-grams, with adaptive prefixes.

A-Z become lower case; words are runs of characters other than space and the controls 9 to 13. A
document's set holds its distinct ``words``-word shingles; with fewer words the whole sequence is the
only one, and without words the set is empty and linked with nothing. Two documents link when
``100 * intersection >= percent * union``. The result is exact but for collisions of 63-bit hashes.

1. Documents with equal sets are one class; only classes are compared.
2. Shingles have one order for all: by hash, those that many documents have last. Two sets that link
   share at least ``l`` shingles among the first ``n - required + l`` of each, for every ``l``. A
   class takes the level ``l`` that promises the fewest candidates: its prefix is then longer by
   ``l - 1`` shingles, and its ``l - 1`` most frequent ones need no look of their own.
3. A class belongs to the group of its most frequent prefix shingle, and visits the groups of
   classes it shares another one with, so a pair meets about once, and not once per shared shingle.
   Groups first get parity signatures, which rule out most pairs; only classes that have a partner
   left send their texts. A pair is verified if it shares as many prefix shingles as the lower level
   of the two asks.
4. Large groups are cut into blocks. All blocks first meet the first block only; what this joins
   into the largest component is not compared with itself again. Tasks hand on a spanning forest of
   the links they find, never all pairs.

NULL is an empty text. NULL ids are ignored for the smallest id of a component, which is NULL if all
are. Equal rows stay rows of their own. Columns named like result columns are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import add_columns, column, kept_columns, text_bytes, text_steps
from .components import connected_components
from .suffix_dedup import text_key

#: Highest level of the adaptive prefixes.
LEVELS = 4
#: Shingles put last in the order, at most. The order decides costs, not results.
FREQUENT = 1 << 18
#: Shingles that a task counts together.
COUNTED = 4_000_000
#: Words of 64 bits in the filter of texts that are compared: what is broadcast has as many rows at most.
FILTER_WORDS = 1 << 20
BLOCK_CLASSES = 128
BLOCK_SHINGLES = 200_000

#: Bytes of text that are hashed at once; a longer text is hashed whole.
SET_BYTES = 1 << 19

#: Classes whose prefixes are worked out together.
PREFIX_ROWS = 256

_SPLIT = np.zeros(256, bool)
_SPLIT[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin and end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(places), np.int64)
    inside = ~_SPLIT[data]
    begins_text, ends_text = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins_text[places[:-1]] = True
    ends_text[places[1:]] = True
    starts = np.flatnonzero(inside & (begins_text[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stops = np.flatnonzero(inside & (ends_text[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    back = np.uint64(pow(int(_A), -1, 1 << 64))
    powers, backs = np.full(len(data), _A), np.full(len(data), back)
    powers[0] = backs[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(backs, out=backs)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    hashes = _mixed((sums[stops] - sums[starts]) * backs[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, places)


def shingle_hashes(data: np.ndarray, places: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all strings of ``words`` words, those across texts included; bounds of texts."""
    hashes, bounds = word_hashes(data, places)
    return _rolled(hashes, words), bounds


def _rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words):
        rolled = rolled * _A + hashes[i : i + len(rolled)]
    return _mixed(rolled) >> np.uint64(1)


def shingle_sets(data: np.ndarray, places: np.ndarray, words: int, frequent: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles in the common order: 63-bit hashes, above 2**63 if frequent."""
    hashes, bounds = word_hashes(data, places)
    rolled = _rolled(hashes, words)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            one = np.unique(rolled[a : b - words + 1])
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, one), len(frequent) - 1)
                last = frequent[at] == one
                one = np.concatenate([one[~last], one[last] | np.uint64(1 << 63)])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                whole = whole * _B + h
            one = _mixed(whole) >> np.uint64(1)
        else:
            one = np.zeros(0, np.uint64)
        sets.append(one)
    return sets


def stepped_sets(texts: pa.Array, words: int, frequent: np.ndarray) -> list[np.ndarray]:
    """``shingle_sets`` of a column, ``SET_BYTES`` of text at a time: hashing takes fifty times their memory."""
    sets = []
    for start, stop in text_steps(texts, SET_BYTES):
        sets += shingle_sets(*text_bytes(texts.slice(start, stop - start)), words, frequent)
    return sets


def signature(one: np.ndarray) -> np.ndarray:
    """Parities of the set's counts in two bits or more for each shingle, a power of two of bits."""
    bits = 1 << max(9, int(2 * len(one) - 1).bit_length()) if len(one) else 512
    return np.packbits(np.bincount((one & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def folded(signs: list[np.ndarray]) -> np.ndarray:
    """Signatures brought to the size of the smallest: halves of a larger one are added."""
    least = min(len(s) for s in signs)
    return np.stack([np.bitwise_xor.reduce(s.reshape(-1, least), axis=0) for s in signs]).view(np.uint64)


def required(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set it links with."""
    return (n * percent + 99) // 100


def found_often(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more sets have, and how many; ``sets`` is emptied."""
    all_ = np.concatenate(sets)
    sets.clear()
    all_.sort()
    thrice = all_[2:] == all_[:-2]
    thrice[1:] &= ~thrice[:-1]  # the first place of each
    firsts = np.flatnonzero(thrice)
    found = all_[firsts]
    return found, np.searchsorted(all_, found, side="right") - firsts


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of many documents: those found three times or more among ``COUNTED`` in some task.

    Every text is counted. The ``FREQUENT`` most frequent are kept, so they fit into every task.
    """

    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = found_often(sets)
        arrays = [pa.array(found.view(np.int64)), pa.array(counts)]
        return pa.RecordBatch.from_arrays(arrays, names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, held, size = np.zeros(0, np.uint64), [], 0
        for batch in batches:
            for start, stop in text_steps(batch.column(0)):
                held += stepped_sets(batch.column(0).slice(start, stop - start), words, none)
                size = sum(map(len, held))
                if size >= COUNTED:
                    yield often(held)
        if held:
            yield often(held)

    counts = docs.select("text").mapInArrow(run, "shingle long, n long")
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("n")).where("n >= 16")
    rows = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").collect()
    return np.sort(np.array([row.shingle for row in rows], np.int64).view(np.uint64))


def _with_sets(docs: DataFrame, words: int, percent: int, frequent: np.ndarray, prefix: bool) -> DataFrame:
    """``docs`` with ``n_shingles``, ``_set`` (a digest) and, if asked for, the longest ``_prefix``."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("_set", T.BinaryType())]
    if prefix:
        fields.append(T.StructField("_prefix", T.ArrayType(T.LongType())))
        fields.append(T.StructField("_sign", T.BinaryType()))

    def compute(texts: pa.Array) -> list[pa.Array]:
        sets = stepped_sets(texts, words, sent.value)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        new = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())]
        if prefix:
            parts = [s[: len(s) - required(len(s), percent) + LEVELS].view(np.int64) for s in sets]
            new.append(pa.array(parts, pa.list_(pa.int64())))
            new.append(pa.array([signature(s).tobytes() for s in sets], pa.binary()))
        return new

    return add_columns(docs, "text", fields, compute, drop=prefix)


def link_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 4, percent: int = 85
) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``component``.

    ``component_id`` is the smallest id that links reach, the own one included; ``component`` stands
    for the same component also where ids are NULL or repeat, and is NULL for an empty set.
    """
    source = docs.select(column(doc_id).alias("id"), column(text).alias("text"))
    frequent = frequent_shingles(source, words)
    keyed = source.withColumn("key", text_key(F.col("text")))
    rows = stored(_with_sets(keyed, words, percent, frequent, True).where("n_shingles > 0"), "sets")
    classes = rows.groupBy("_set").agg(
        F.min("id").alias("id"), F.min("key").alias("key"), F.first("n_shingles").alias("n"),
        F.first("_prefix").alias("prefix"), F.first("_sign").alias("sign"),
    )
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    texts = source.select("text")
    groups = stored(_groups(classes, percent), "groups")
    links = stored(_compare(texts, classes, groups, None, words, percent, frequent), "links")
    found = connected_components(links, "a", "b")
    large = groups.groupBy("group").agg(_blocks().alias("blocks")).where("blocks > 1").select("group")
    if not large.isEmpty():
        again = groups.join(large, "group").join(found.withColumnRenamed("node", "class"), "class", "left")
        again = stored(again.withColumn("component", F.coalesce("component", "class")), "again")
        more = _compare(texts, classes, again.drop("component"), again, words, percent, frequent)
        links = stored(links.union(more), "links")
        found = connected_components(links, "a", "b")
    known = classes.select("class", "id", "_set").join(found.withColumnRenamed("node", "class"), "class", "left")
    known = stored(known.withColumn("component", F.coalesce("component", "class")), "members")
    least = known.groupBy("component").agg(F.min("id").alias("component_id"))
    names = known.join(least, "component").select("_set", "component_id", "component")
    kept = kept_columns(docs, ["n_shingles", "component_id", "component"])
    own = docs.select(*map(column, kept), column(text).alias("_text"), column(doc_id).alias("_own"))
    own = _with_sets(own.withColumnRenamed("_text", "text") if "text" not in kept else own.drop("_text"), words, percent, frequent, False)
    # empty sets get keys of their own, so they match nothing and do not meet in one task
    alone = F.concat(F.lit("row "), F.monotonically_increasing_id()).cast("binary")
    own = own.withColumn("_set", F.coalesce("_set", alone)).join(names, "_set", "left")
    component_id = F.when(F.col("n_shingles") == 0, F.col("_own")).otherwise(F.col("component_id"))
    return own.select(*map(column, kept), "n_shingles", component_id.alias("component_id"), "component")


def _blocks() -> Column:
    """Into how many blocks a group is cut."""
    by_classes = F.ceil(F.count("*") / F.lit(BLOCK_CLASSES))
    return F.greatest(by_classes, F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")


def _groups(classes: DataFrame, percent: int) -> DataFrame:
    """``group, class, native, level, n``: the groups of at least two classes."""
    width = -4 * math.log(percent / 100)
    low = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    high = F.floor(F.log(F.col("n") * (100 / percent + 1e-9)) / width).cast("int")
    sized = classes.select("class", "prefix", F.explode(F.array_distinct(F.array(low, high))).alias("size"))
    tokens = sized.select("class", "size", F.posexplode("prefix").alias("place", "token"))
    tokens = tokens.select("class", "size", "place", F.xxhash64("token", "size").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(often, "token")
    per_class = shared.groupBy("class", "size").agg(F.collect_list(F.struct("df", "token", "place")).alias("all"))
    per_class = per_class.join(classes.select("class", "n"), "class").select("class", "n", "all")
    schema = "class long, n long, level int, home long, token long, left_out boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from prefix_rows(batch, percent)

    looked = stored(per_class.mapInArrow(run, schema), "prefixes")
    homes = looked.groupBy("token", F.col("home").alias("group")).agg(F.min("left_out").alias("all_left_out"))
    visits = looked.join(homes, "token").where("group > home AND NOT (left_out AND all_left_out)")
    visits = visits.select("group", "class", "level", "n").distinct().withColumn("native", F.lit(False))
    natives = looked.select(F.col("home").alias("group"), "class", "level", "n").distinct()
    both = natives.withColumn("native", F.lit(True)).unionByName(visits)
    both = stored(both, "memberships")
    many = both.groupBy("group").agg(F.count("*").alias("members")).where("members > 1").select("group")
    return both.join(many, "group").select("group", "class", "native", "level", "n")


def prefix_rows(batch: pa.RecordBatch, percent: int) -> Iterator[pa.RecordBatch]:
    """``adaptive_prefix`` of rows ``class, n, all``, some at a time: as Python objects they take ten times their memory."""
    for start in range(0, batch.num_rows, PREFIX_ROWS):
        rows = [
            (c, n, *prefix)
            for c, n, all_ in zip(*(x.to_pylist() for x in batch.slice(start, PREFIX_ROWS).columns))
            for prefix in adaptive_prefix(n, [tuple(t.values()) for t in all_], percent)
        ]
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["class", "n", "level", "home", "token", "left_out"])


def adaptive_prefix(n: int, shared: list[tuple[int, int, int]], percent: int) -> list[tuple]:
    """``level, home, token, left_out`` of a class, for the level with the fewest likely candidates.

    ``shared`` has ``df, token, place`` of the shingles in its longest prefix that others have too.
    ``home`` is the most frequent shingle that is looked at; the ``level - 1`` above it are left out.
    """
    first = n - required(n, percent)
    shared = sorted(shared, reverse=True)
    best = None
    for level in range(1, min(LEVELS, required(n, percent)) + 1):
        within = [t for t in shared if t[2] < first + level]
        cost = sum(t[0] - 1 for t in within[level - 1 :])
        if best is None or cost < best[0]:
            best = cost, level, within
    _, level, within = best
    if len(within) < level:
        return []
    home = within[level - 1][1]
    return [(level, home, token, i < level - 1) for i, (_, token, _) in enumerate(within)]


def _compare(
    texts: DataFrame, classes: DataFrame, groups: DataFrame, components: DataFrame | None, words: int,
    percent: int, frequent: np.ndarray,
) -> DataFrame:
    """``a, b``: a spanning forest of the links that each task finds.

    Without ``components``, the blocks of a large group meet its first block and themselves. With
    them (``group, class, component``), classes outside the group's largest component meet all.
    """
    if components is None:
        size = groups.groupBy("group").agg(_blocks().alias("blocks"))
        dealt = groups.join(size, "group").withColumn(
            "block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
        )
        all_ = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.lit(0).alias("i"), i.alias("j")))
        own = F.array(F.struct(F.lit(0).alias("i"), F.col("block").alias("j")))
        pairs = F.when(F.col("block") == 0, all_).otherwise(own)
    else:
        counts = components.groupBy("group", "component").agg(F.count("*").alias("n"))
        main = counts.groupBy("group").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
        marked = components.select("group", "class", "component").join(main, "group")
        marked = marked.withColumn("outside", F.col("component") != F.col("main"))
        rows = groups.join(marked.select("group", "class", "outside"), ["group", "class"])
        size = rows.groupBy("group", "outside").agg(_blocks().alias("blocks"))
        size = size.groupBy("group").agg(
            F.max(F.when(F.col("outside"), F.col("blocks"))).alias("out"),
            F.max(F.when(~F.col("outside"), F.col("blocks"))).alias("in"),
        )
        dealt = rows.join(size.where("out IS NOT NULL"), "group")
        hashed = F.xxhash64("class")
        block = F.when(F.col("outside"), F.pmod(hashed, F.col("out"))).otherwise(F.col("out") + F.pmod(hashed, F.col("in")))
        dealt = dealt.withColumn("block", block.cast("int"))
        others = F.transform(
            F.sequence(F.lit(0), F.col("out") + F.col("in") - 1),
            lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")),
        )
        outer = F.transform(F.sequence(F.lit(0), F.col("out") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
        pairs = F.when(F.col("outside"), others).otherwise(outer)
    tasks = dealt.select("class", "n", "native", "level", "group", "block", F.explode(F.array_distinct(pairs)).alias("pair"))
    tasks = tasks.select("class", "n", "native", "level", "group", "block", "pair.i", "pair.j")
    across = components is not None
    schema = "class long, native boolean, level int, group long, block int, i int, j int"

    def near(key: tuple, group: pa.Table) -> pa.Table:
        n, native, block = (group.column(c).to_numpy(zero_copy_only=False) for c in ("n", "native", "block"))
        signs = [np.frombuffer(s, np.uint8) for s in group.column("sign").to_pylist()]
        keep = with_partner(n, signs, native.astype(bool), block, percent, across)
        return group.select([f.split()[0] for f in schema.split(", ")]).filter(pa.array(keep))

    signed = tasks.join(classes.select("class", "sign"), "class")
    tasks = signed.groupBy("group", "i", "j").applyInArrow(near, schema)
    to = F.struct("class", "native", "level", "group", "block", "i", "j")
    lists = tasks.join(classes.select("class", "key"), "class").groupBy("key").agg(F.collect_list(to).alias("to"))
    lists = stored(lists, "tasks")
    keyed = texts.select(text_key(F.col("text")).alias("key"), "text")
    # copies of a text meet in their own task first, so a frequent one is sent once by each
    one = _likely(keyed, "key", lists).groupBy("key").agg(F.first("text").alias("text"))
    rows = one.join(lists, "key").select("text", F.explode("to").alias("t")).select("text", "t.*")
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sets = stepped_sets(group.column("text").combine_chunks(), words, sent.value)
        kinds = [group.column(c).to_numpy(zero_copy_only=False) for c in ("class", "native", "level", "block")]
        found = forest(sets, *kinds, percent, across)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("group", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``; a join must follow."""
    return _marked(rows, key, wanted).where("_maybe").drop("_maybe")


def _marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false only if ``key`` is not in ``wanted``.

    Every wanted key sets one of 64 * ``FILTER_WORDS`` bits. The more keys there are, the more
    others are marked, but the filter that is broadcast does not grow.
    """
    hashed = F.xxhash64(key)
    word = F.pmod(hashed, F.lit(FILTER_WORDS)).cast("int").alias("_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58).cast("int")).alias("_bit")
    bits = wanted.select(word, bit).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    both = rows.select("*", word, bit).join(F.broadcast(bits), "_word", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return both.select(*rows.columns, maybe.alias("_maybe"))


def _partners(x: int, n: np.ndarray, signs: np.ndarray, native: np.ndarray, block: np.ndarray, percent: int, across: bool) -> np.ndarray:
    """Which of the smaller sets, in order of size, may link with set ``x``."""
    low = int(np.searchsorted(n[: x + 1], required(int(n[x]), percent)))
    both = n[low:x] + n[x]
    most = both - 2 * -(-percent * both // (100 + percent))  # largest symmetric difference of a link
    maybe = np.bitwise_count(signs[low:x] ^ signs[x]).sum(1, dtype=np.int64) <= most
    maybe &= native[low:x] | native[x]
    if across:
        maybe &= block[low:x] != block[x]
    return np.flatnonzero(maybe) + low


def with_partner(n: np.ndarray, signs: list[np.ndarray], native: np.ndarray, block: np.ndarray, percent: int, across: bool) -> np.ndarray:
    """Which sets of a task have another one that they may link with."""
    order = np.argsort(n, kind="stable")
    small, across = folded([signs[i] for i in order]), across and len(set(block.tolist())) > 1
    keep = np.zeros(len(n), bool)
    n, native, block = n[order], native[order], block[order]
    for x in range(1, len(n)):
        found = _partners(x, n, small, native, block, percent, across)
        if len(found):
            keep[found] = keep[x] = True
    result = np.zeros(len(n), bool)
    result[order] = keep
    return result


def forest(sets, classes, native, level, block, percent: int, across: bool) -> list[tuple[int, int]]:
    """Links that join these sets' components; two visitors are not compared.

    ``across``: sets of one block are compared in the task of that block alone.
    """
    n = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((classes, n))
    sets = [sets[i] for i in order]
    n, classes, native, level, block = n[order], classes[order], native[order].astype(bool), level[order], block[order]
    signs, across = folded([signature(s) for s in sets]), across and len(set(block.tolist())) > 1
    first = [len(s) - required(len(s), percent) for s in sets]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for x in range(1, len(sets)):
        for y in _partners(x, n, signs, native, block, percent, across).tolist():
            if root(x) == root(y):
                continue
            k = int(min(level[x], level[y]))
            if len(np.intersect1d(sets[x][: first[x] + k], sets[y][: first[y] + k], True)) < k:
                continue
            shared = len(np.intersect1d(sets[x], sets[y], True))
            if 100 * shared >= percent * (n[x] + n[y] - shared):
                parent[root(x)] = root(y)
                found.append((int(classes[x]), int(classes[y])))
    return found


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component, one row with the smallest id.

    Of several texts with that id one stays, and of rows that repeat both, any one. Texts without
    words are linked with nothing, so all their rows stay. A component whose ids are all NULL keeps
    one row too. All columns stay as they are.

    What goes is decided on ids and digests; of the texts, only those that go and the few that the
    filter takes for such are shuffled.
    """
    narrow = docs.select(column(doc_id).alias("id"), column(text).alias("text"))
    linked = link_documents(narrow, "id", "text", words=words, percent=percent).where("component IS NOT NULL")
    linked = stored(linked.select(
        _row_key(F.col("id"), F.col("text")).alias("_key"), F.col("id").eqNullSafe(F.col("component_id")).alias("least"), "component",
    ), "linked")
    chosen = linked.where("least").groupBy("component").agg(F.min("_key").alias("chosen"))
    counts = linked.groupBy("_key", "component").agg(F.count("*").alias("rows")).join(chosen, "component")
    counts = counts.select("_key", "rows", (F.col("_key") == F.col("chosen")).alias("stays"))
    moved = stored(counts.where("rows > 1 OR NOT stays").select("_key", "stays"), "moved")
    repeated = moved.where("stays").select("_key")
    row = F.struct(*map(column, docs.columns)).alias("row")
    rows = docs.select(_row_key(column(doc_id), column(text)).alias("_key"), row)
    marked = _marked(rows, "_key", moved)
    alone = marked.where("NOT _maybe").select("row.*")
    others = marked.where("_maybe").join(moved, "_key", "left_anti").select("row.*")
    one = _likely(rows, "_key", repeated).groupBy("_key").agg(F.first("row").alias("row"))
    return alone.union(others).union(one.join(repeated, "_key", "left_semi").select("row.*"))


def _row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for an id and a text; NULL is an id of its own."""
    name = F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(text_key(text), name.cast("binary"))))
