"""Benchmark decontamination: one Aho-Corasick automaton over test items, each text scanned once.

Texts and items are brought to the same form: A-Z in lower case, and words that are runs of ASCII
digits, ASCII letters and characters beyond ASCII. A window is ten consecutive words of an item; an
item of fewer words, but not none, is one window. A word of a document that lies inside any
occurrence of a window is hit. Hits carry character offsets into the original text.

The automaton holds all windows while they have at most ``MOST_BYTES`` together; a larger set is
cut into blocks of that size, each with an automaton and a scan of its own, and hits are merged.

NULL and empty texts have no words and no hits. NULL, empty or wordless items have no windows;
items without an id take no part; rows of one id count as one item. Columns named like result
columns are replaced.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import column, kept_columns, text_bytes

WINDOW = 10
#: Bytes of distinct windows for one automaton, which needs about fifty times as much memory.
MOST_BYTES = 2_000_000
#: Scans that follow each other before their rows are written.
_IN_A_ROW = 3

_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField(
        "hits",
        T.ArrayType(
            T.StructType(
                [T.StructField(n, T.LongType()) for n in ("first_word", "last_word", "start", "end")]
            )
        ),
    ),
]
_ITEMS, _HITS = pa.list_(pa.string()), pa.list_(
    pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start", "end")])
)


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, window``: the windows of all items, words joined by one space."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(column(text), upper, upper.lower())
    words = F.filter(
        F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda word: word != ""
    )
    last = F.greatest(F.size("words") - WINDOW, F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_join(F.slice("words", i + 1, WINDOW), " "),
    )
    known = items.select(column(item_id).cast("string").alias("item"), words.alias("words"))
    known = known.where(F.col("item").isNotNull() & (F.size("words") > 0))
    return known.select("item", F.explode(windows).alias("window")).distinct()


def _automaton(windows: list[tuple[str, str]]) -> ahocorasick.Automaton | None:
    if not windows:
        return None
    items: dict[str, list[str]] = {}
    for item, window in windows:
        items.setdefault(f" {window} ".encode().decode("latin-1"), []).append(item)
    automaton = ahocorasick.Automaton()
    for window, found in items.items():
        automaton.add_word(window, (window.count(" ") - 1, found))
    automaton.make_automaton()
    return automaton


_automata: dict[str, ahocorasick.Automaton | None] = {}


def _scan(text: bytes, automaton: ahocorasick.Automaton | None) -> tuple[int, set[str], list[dict]]:
    words = text.translate(_NORMAL).split()
    if not words or automaton is None:
        return len(words), set(), []
    normal = b" " + b" ".join(words) + b" "
    ends, lengths, items = [], [], set()
    for end, (n, found) in automaton.iter(normal.decode("latin-1")):
        ends.append(end)
        lengths.append(n)
        items.update(found)
    if not ends:
        return len(words), items, []
    gaps = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    last = np.searchsorted(gaps, ends) - 1
    return len(words), items, _runs(text, len(words), last - np.array(lengths) + 1, last)


def _runs(text: bytes, n: int, first: np.ndarray, last: np.ndarray) -> list[dict]:
    """Maximal runs of hit words with their places in the text, counted in characters."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, first, 1)
    np.add.at(marks, last + 1, -1)
    edges = np.diff((np.cumsum(marks) > 0).astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    plain = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    at = np.diff(plain.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(at == 1), np.flatnonzero(at == -1)
    whole = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # bytes that begin a character
    chars = np.concatenate([[0], np.cumsum(whole)])
    return [
        {"first_word": int(a), "last_word": int(b), "start": int(chars[starts[a]]), "end": int(chars[stops[b]])}
        for a, b in zip(first, last)
    ]


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_words``, ``items`` (ids as strings, sorted) and ``hits`` (runs of hit words)."""
    spark = docs.sparkSession
    windows = stored(item_windows(items, item_id, item_text), "windows")
    total = windows.agg(F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()[0]
    blocks = -(-total // MOST_BYTES) or 1
    place = F.pmod(F.xxhash64("window"), F.lit(blocks))
    found = docs
    for block in range(blocks):
        part = windows.where(place == block).orderBy("window", "item").collect()
        found = _find(found, [(row.item, row.window) for row in part], text, block > 0)
        if block % _IN_A_ROW == _IN_A_ROW - 1 and block + 1 < blocks:
            found = stored(found, "hits")
    return found


def _find(docs: DataFrame, windows: list[tuple[str, str]], text: str, more: bool) -> DataFrame:
    """One scan; ``more`` adds to the hits of earlier ones."""
    data = pickle.dumps(windows)
    sent, key = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
    kept = kept_columns(docs, [f.name for f in _RESULT])
    n = len(kept)
    names = [f.name for f in _RESULT]
    earlier = [column(name) if more else F.lit(None).alias(name) for name in names[1:]]
    source = docs.select(*map(column, kept), column(text).alias("_text"), *earlier)
    schema = T.StructType(source.schema.fields[:n] + _RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _automata:
            _automata.clear()
            _automata[key] = _automaton(pickle.loads(sent.value))
        automaton = _automata[key]
        for batch in batches:
            data, places = text_bytes(batch.column(n))
            counts, all_items, all_hits = [], [], []
            for i in range(batch.num_rows):
                one = data[places[i] : places[i + 1]].tobytes()
                count, items, hits = _scan(one, automaton)
                if more and (old := batch.column(n + 1)[i].as_py()):
                    items |= set(old)
                    both = hits + batch.column(n + 2)[i].as_py()
                    first, last = (np.array([h[x] for h in both]) for x in ("first_word", "last_word"))
                    hits = _runs(one, count, first, last)
                counts.append(count)
                all_items.append(sorted(items))
                all_hits.append(hits)
            new = [pa.array(counts, pa.int64()), pa.array(all_items, _ITEMS), pa.array(all_hits, _HITS)]
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + new, names=batch.schema.names[:n] + names)

    return source.mapInArrow(run, schema)


def hit_words() -> F.Column:
    """How many words of a document are hit."""
    return F.aggregate(
        "hits", F.lit(0).cast("long"), lambda n, hit: n + hit["last_word"] - hit["first_word"] + 1
    )
