"""Ranked lexical search: documents' impact vectors in order of their length, pruned as in LEMP.

A document's vector has an impact for each of its terms that also stands in some item; an item's vector
has each term's weight times its occurrences. A score is their inner product, in integers:

* terms: runs of ASCII digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII;
* weight: ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``, N documents with a term, df with this one;
* impact: ``1_000_000_000 * tf div (1000 * tf + 12 * m)``, ``m = 100 - 25 + 25 * n * N div L``, for a
  document of n terms, L terms in all.

Vectors are written in falling order of length and searched in waves, the longest first. A run of about
4,000 neighbours is a bucket. With t the score an item's k-th best document has so far:

1. Cauchy and Schwarz: a bucket whose longest vector times the item's is below t holds nothing for the
   item; vectors too short for every item are not even read, as the files tell their lengths.
2. Coordinates: inside a bucket each coordinate of an item is at most its weight times the bucket's largest
   impact. The coordinates that even together can't reach t (by these bounds, or by the length of what is
   left of the item) need not be looked up: a document must have one of the others. Their products are added up;
   documents whose sum and bound of the rest, by coordinates and by length, stay below t go.
3. Survivors are scored exactly, in integers, and the item's best are kept, which raises t.

Bounds only ever drop documents below t, so the result is that of scoring every pair. Terms of items are
sent to the tasks in blocks of at most ``MOST_BYTES``, items in blocks of at most ``MOST_PAIRS`` terms.

NULL and empty texts have no terms: such documents do not count in N and are not found, such items find
nothing. Every document row is a document of its own; one without an id can be found and comes after those
of equal score. Items without an id take no part; of an item's rows equal texts count once, terms of
different texts together. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import local_rows, stored, workspace
from .common import column, text_bytes, text_steps

TOP = 20
#: Bytes of distinct terms that tasks hold at once; their table needs about fifty times as much memory.
MOST_BYTES = 2_000_000
#: Distinct terms of all items of a block, an item with more being a block of its own.
MOST_PAIRS = 200_000
#: Vectors of a bucket.
BUCKET = 4096
#: Vectors of a written file.
_FILE_ROWS = 2 * BUCKET
#: Parts of all vectors, longest first, after which a wave ends.
_WAVES = (1 / 64, 1 / 8)
#: Bytes of a text that are split at once.
_CHUNK = 1 << 20
#: Passes that follow each other before their rows are written.
_IN_A_ROW = 3

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a lower-cased text
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_SLACK = 1 + 1e-9  # above what doubles may lose in a bound


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, term, repeats`` of all items."""
    rows = items.select(column(item_id).alias("item"), column(text).alias("text"))
    rows = rows.where("item IS NOT NULL AND text IS NOT NULL").distinct()
    words = F.split(F.translate("text", _UPPER, _UPPER.lower()), _BREAKS)
    terms = rows.select("item", F.explode(words).alias("term")).where("term <> ''")
    return terms.groupBy("item", "term").agg(F.count("*").alias("repeats"))


def count_terms(text: bytes, known: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of terms of a text, and how often the known ones occur, a part of a long text at a time."""
    n, counts, start = 0, Counter(), 0
    while start < len(text):
        stop = start + _CHUNK
        normal = text[start:stop].translate(_NORMAL)
        if stop < len(text) and 32 not in (normal[-1], _NORMAL[text[stop]]):  # inside a term: up to its beginning or end
            cut = normal.rfind(b" ") + 1
            if cut:
                stop = start + cut
                normal = normal[:cut]
            else:
                while stop < len(text) and _NORMAL[text[stop]] != 32:
                    stop += 1
                normal = text[start:stop].translate(_NORMAL)
        words = normal.split()
        n += len(words)
        counts.update(filter(known.__contains__, words))
        start = stop
    return n, counts


def _add_terms(docs: DataFrame, known: list[tuple[str, int]], more: bool) -> DataFrame:
    """``doc_id, text, n, terms, tfs`` of rows ``doc_id, text``; ``more`` adds to the terms of earlier blocks."""
    fields = [T.StructField("n", T.LongType()), *[T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("terms", "tfs")]]
    schema = T.StructType(docs.schema.fields[:2] + fields)
    names = schema.names
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {term.encode(): i for term, i in sent.value}
        for batch in batches:
            for start, stop in text_steps(batch.column(1)):
                part = batch.slice(start, stop - start)
                data, places = text_bytes(part.column(1))
                ns, terms, tfs = [], [], []
                for i in range(part.num_rows):
                    n, counts = count_terms(data[places[i] : places[i + 1]].tobytes(), table)
                    ns.append(n)
                    terms.append([table[term] for term in counts])
                    tfs.append(list(counts.values()))
                    if more:
                        terms[-1] += part.column(3)[i].as_py()
                        tfs[-1] += part.column(4)[i].as_py()
                kinds = pa.list_(pa.int32())
                new = [pa.array(ns, pa.int64()), pa.array(terms, kinds), pa.array(tfs, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *new], names=names)

    return docs.mapInArrow(run, schema)


def _with_terms(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, terms, tfs`` of the documents, and ``term, id`` of the distinct ``terms``."""
    spark = terms.sparkSession
    total = terms.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    blocks = -(-total // MOST_BYTES) or 1
    path = workspace(spark, "term-ids")
    found, first = docs, 0
    for block in range(blocks):
        place = F.pmod(F.xxhash64("term"), F.lit(blocks))
        rows = terms.where(place == block).orderBy("term").collect()
        known = [(row.term, first + i) for i, row in enumerate(rows)]
        first += len(known)
        local_rows(spark, known, "term string, id int").write.mode("append").parquet(path)
        found = _add_terms(found, known, block > 0)
        if block % _IN_A_ROW == _IN_A_ROW - 1 and block + 1 < blocks:
            found = stored(found, "terms")
    return stored(found.drop("text"), "terms"), spark.read.schema("term string, id int").parquet(path)


def impact_vectors(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``doc_id, length, terms, impacts`` of ``n, terms, tfs``; ``length`` is never below the vector's own."""
    m = F.lit(100 - 25) + F.call_function("div", F.lit(25) * F.col("n") * F.lit(n_docs), F.lit(n_terms or 1))

    def impact(tf: F.Column) -> F.Column:
        tf = tf.cast("long")
        return F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(12) * m)

    rows = counted.where(F.size("terms") > 0).select("doc_id", "terms", F.transform("tfs", impact).alias("impacts"))
    squares = F.aggregate("impacts", F.lit(0.0), lambda done, x: done + x.cast("double") * x)
    return rows.select("doc_id", (F.sqrt(squares) * _SLACK).alias("length"), "terms", "impacts")


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    top: int = TOP,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` best documents with a score above 0."""
    spark = docs.sparkSession
    asked = stored(item_terms(items, item_id, item_text), "item-terms")
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    counted, ids = _with_terms(rows, stored(asked.select("term").distinct(), "terms"))
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counted.select(F.explode("terms").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    weight = F.floor(F.log(F.lit(2.0 * n_docs + 2) / (F.lit(2) * F.col("df") + 1)) * 1000)
    weighted = asked.join(ids.join(df, "id"), "term").select("item", "id", (weight * F.col("repeats")).alias("weight"))
    weighted = stored(weighted.where("weight > 0"), "item-vectors")

    made = impact_vectors(counted, n_docs, n_terms)
    files = -(-n_docs // _FILE_ROWS) or 1
    by = [F.desc("length"), F.desc("doc_id"), F.rand(1)]  # equal vectors, and equal rows, spread over files
    vectors = stored(made.repartitionByRange(files, *by).sortWithinPartitions(*by[:2]), "vectors")
    parts = [1 - part for part in _WAVES]
    marks = vectors.agg(F.percentile_approx("length", parts, 10_000).alias("marks")).first().marks or []

    schema = T.StructType([weighted.schema["item"], *T._parse_datatype_string("doc_id long, score long").fields])
    path = workspace(spark, "best")
    spark.createDataFrame([], schema).write.parquet(path)
    pairs = weighted.count()
    item_blocks = -(-pairs // MOST_PAIRS) or 1
    for block in range(item_blocks):
        here = F.pmod(F.xxhash64("item"), F.lit(item_blocks)) == block
        _search_block(vectors, weighted.where(here), marks, top, path, schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_id), "rank", "doc_id", "score")


def _search_block(
    vectors: DataFrame, weighted: DataFrame, marks: list[float], top: int, path: str, schema: T.StructType
) -> None:
    """Writes the best documents of a block's items, wave after wave, each with what the last ones found."""
    spark = vectors.sparkSession
    rows = weighted.groupBy("item").agg(F.collect_list("id").alias("ids"), F.collect_list("weight").alias("weights"))
    queries = [(row.item, np.array(row.ids, np.int64), np.array(row.weights, np.int64)) for row in rows.collect()]
    if not queries:
        return
    lengths = np.array([np.sqrt((q[2].astype(float) ** 2).sum()) for q in queries]) * _SLACK
    items = spark.createDataFrame([(q[0], i) for i, q in enumerate(queries)], T.StructType([schema["item"], T.StructField("query", T.IntegerType())]))
    least = np.zeros(len(queries), np.int64)
    above: float | None = None
    for mark in [*marks, None]:
        if mark is not None and above is not None and mark >= above:
            continue
        floor = float((least / lengths).min())
        part = vectors.where(F.col("length") >= floor)
        part = part if mark is None else part.where(F.col("length") >= mark)
        part = part if above is None else part.where(F.col("length") < above)
        above = mark
        found = part.mapInArrow(_best_of_task([q[1:] for q in queries], lengths, least, top), "query int, doc_id long, score long")
        found.join(items, "query").select("item", "doc_id", "score").write.mode("append").parquet(path)
        if mark is not None:
            order = Window.partitionBy("item").orderBy(F.desc("score"))
            last = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(order))
            for row in last.where(F.col("rank") == top).join(items, "item").select("query", "score").collect():
                least[row.query] = row.score


class Bucket:
    """Neighbouring vectors, with the documents and impacts of each term."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.size = batch.num_rows
        ids = batch.column("doc_id")
        self.nameless = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        self.lengths = np.asarray(batch.column("length"))
        self.longest = float(self.lengths.max(initial=0))
        terms = np.asarray(batch.column("terms").flatten())
        impacts = np.asarray(batch.column("impacts").flatten())
        counts = np.asarray(pa.compute.list_value_length(batch.column("terms")))
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(self.size), counts)[order]
        self.impacts = impacts[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.edges = np.append(starts, len(terms))
        self.most = np.maximum.reduceat(self.impacts, starts) if len(starts) else self.impacts

    def coordinates(self, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of an item's terms that the bucket has, and their weights."""
        at = np.searchsorted(self.terms, ids)
        inside = at < len(self.terms)
        inside[inside] = self.terms[at[inside]] == ids[inside]
        return at[inside], weights[inside]

    def search(self, ids: np.ndarray, weights: np.ndarray, length: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score of at least ``least``, which is 1 or more, and perhaps none others; exact scores."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if length * self.longest < least:
            return nothing
        at, weights = self.coordinates(ids, weights)
        if not len(at):
            return nothing
        bounds = weights * self.most[at]
        order = np.argsort(bounds)
        at, weights, bounds = at[order], weights[order], bounds[order]
        rest_sum = np.cumsum(bounds)
        rest_length = np.sqrt(np.cumsum(weights.astype(float) ** 2)) * _SLACK
        idle = int(np.searchsorted(np.minimum(rest_sum, rest_length * self.longest), least))
        if idle == len(at):
            return nothing
        pieces = [slice(self.edges[a], self.edges[a + 1]) for a in at]
        docs = np.concatenate([self.docs[p] for p in pieces[idle:]])
        impacts = np.concatenate([self.impacts[p] for p in pieces[idle:]])
        products = impacts * np.repeat(weights[idle:], [p.stop - p.start for p in pieces[idle:]])
        sums = np.bincount(docs, products, self.size)
        if idle:
            left = self.lengths**2 - np.bincount(docs, impacts.astype(float) ** 2, self.size)
            rest = rest_length[idle - 1] * np.sqrt(np.maximum(left, 0) + self.lengths**2 * 1e-9)
            bound = (sums + np.minimum(rest, rest_sum[idle - 1])) * _SLACK
        else:
            bound = sums * _SLACK
        survivors = np.flatnonzero((sums > 0) & (bound >= least))
        if not len(survivors):
            return nothing
        scores = np.zeros(len(survivors), np.int64)
        for weight, piece in zip(weights.tolist(), pieces):
            here = self.docs[piece]
            place = np.searchsorted(here, survivors)
            hit = place < len(here)
            hit[hit] = here[place[hit]] == survivors[hit]
            scores[hit] += weight * self.impacts[piece][place[hit]]
        reached = scores >= least
        return survivors[reached], scores[reached]


def _best_of_task(
    queries: list[tuple[np.ndarray, np.ndarray]], lengths: np.ndarray, least: np.ndarray, top: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each item's best documents of the vectors of a task, without those below what is known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = np.maximum(least, 1)
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET):
                bucket = Bucket(batch.slice(start, BUCKET))
                for query in np.flatnonzero(lengths * bucket.longest >= needed):
                    rows, scores = bucket.search(*queries[query], lengths[query], int(needed[query]))
                    if not len(rows):
                        continue
                    new = np.stack([-scores, bucket.nameless[rows], bucket.ids[rows]])
                    both = np.concatenate([best[query], new], axis=1) if query in best else new
                    both = both[:, np.lexsort(both[::-1])[:top]]
                    best[query] = both
                    if both.shape[1] == top:
                        needed[query] = max(needed[query], -both[0, -1])
        if best:
            sizes = [rows.shape[1] for rows in best.values()]
            score, nameless, ids = np.concatenate(list(best.values()), axis=1)
            query = np.repeat(np.array(list(best), np.int32), sizes)
            arrays = [pa.array(query), pa.array(ids, mask=nameless.astype(bool)), pa.array(-score)]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "doc_id", "score"])

    return run
