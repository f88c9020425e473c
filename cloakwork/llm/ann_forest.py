"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the inner product. Vectors get one more component that makes all as long as the longest
one, so the nearest by angle are those of the largest inner product. Each tree halves a sample of at
most ``sample_rows`` vectors (in expectation) by random directions at their medians. A query puts
the nodes of all trees into one priority queue, by the smallest margin on the way, and takes leaves
from it; how many is measured on the sample, for ``target`` recall. Every vector is indexed in every
tree. Leaves that lie together form blocks; a task compares the queries of a block with the vectors
of their leaves, and the best of all blocks are ranked by the inner product of the original vectors,
summed in double precision from the first component to the last.

Vectors that are NULL, empty, zero, or hold NULL, NaN or infinite components take no part, nor do
those of another length than most have (at a tie, the longer one). Equal vectors are indexed once, with their smallest
ids and how many rows have each, which is enough for ``k`` neighbours. Rows with the same id, equal vectors or not, are
rows of their own as candidates; a query excludes its id. Where the query's id has other vectors too, those among the
nearest take places that are not filled again. Queries without any candidate have no rows. NULL ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import column

#: Vectors in one block of leaves, as far as the sample tells, and of one task.
BLOCK_VECTORS = 8192


@dataclass(frozen=True)
class Forest:
    """``normals`` and ``cuts`` of the inner nodes of perfect binary trees; node i has 2i+1 and 2i+2."""

    normals: np.ndarray
    cuts: np.ndarray
    depth: int
    longest: float
    probes: int

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(1), 0))
        return np.concatenate([vectors, rest[:, None]], 1) / self.longest

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        lifted = self.lifted(vectors)
        found = np.empty((len(vectors), len(self.normals)), np.int32)
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                side = np.einsum("nd,nd->n", lifted, normals[node]) > cuts[node]
                node = 2 * node + 1 + side
            found[:, t] = node - (2**self.depth - 1)
        return found

    def probed(self, queries: np.ndarray, most: int | None = None) -> list[list[tuple[int, int]]]:
        """For each query, trees and leaves in the order in which the queue gives them."""
        length = np.sqrt((queries**2).sum(1, keepdims=True))
        lifted = np.concatenate([queries / length, np.zeros((len(queries), 1))], 1)
        margins = np.einsum("qd,tnd->qtn", lifted, self.normals) - self.cuts
        inner, trees = 2**self.depth - 1, len(self.normals)
        most, found = most or self.probes, []
        for one in margins:
            queue = [(-np.inf, t, 0) for t in range(trees)]
            order: list[tuple[int, int]] = []
            rows = one.tolist()
            while queue and len(order) < most:
                worst, t, node = heappop(queue)
                while node < inner:
                    margin = rows[t][node]
                    near, far = (2, 1) if margin > 0 else (1, 2)
                    heappush(queue, (max(worst, abs(margin)), t, 2 * node + far))
                    node = 2 * node + near
                order.append((t, node - inner))
            found.append(order)
        return found


def fit_forest(sample: np.ndarray, longest: float, *, trees: int, leaf: int, k: int, target: float, seed: int = 1) -> Forest:
    """A forest over a sample, with the number of leaves that finds ``target`` of its true neighbours."""
    rng = np.random.default_rng(seed)
    n, width = sample.shape
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    inner = 2**depth - 1
    normals = rng.normal(size=(trees, inner, width + 1))
    cuts = np.zeros((trees, inner))
    forest = Forest(normals, cuts, depth, longest, 1)
    lifted = forest.lifted(sample)
    for t in range(trees):
        node = np.zeros(n, np.int64)
        for _ in range(depth):
            along = np.einsum("nd,nd->n", lifted, normals[t][node])
            for here in np.unique(node):
                cuts[t, here] = np.median(along[node == here])
            node = 2 * node + 1 + (along > cuts[t][node])
    asked = rng.choice(n, min(n, 256), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, n - 1)]
    leaves = forest.leaves(sample)
    firsts = []
    for order, wanted in zip(forest.probed(sample[asked], trees * 2**depth), near):
        place = np.full((trees, 2**depth), trees * 2**depth)
        for i, (t, leaf_) in enumerate(order):
            place[t, leaf_] = i + 1
        firsts += place[np.arange(trees), leaves[wanted]].min(1).tolist()
    probes = int(np.ceil(np.quantile(firsts, target))) if firsts else 1
    return Forest(normals, cuts, depth, longest, probes)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", *, k: int = 20,
    trees: int = 16, leaf: int = 256, sample_rows: int = 50_000, target: float = 0.95,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row that ``queries`` selects.

    ``queries`` is a condition on the columns of ``vectors``. Candidates are all rows but those with
    the query's id. Ties go to the smaller id.
    """
    rows = vectors.select(
        column(vec_id).alias("id"),
        F.transform(column(embedding), lambda x: x.cast("double") + F.lit(0.0)).alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asked"),
    ).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = lengths[0].d if lengths else 0
    rows = rows.where(F.size("v") == width)
    classes = stored(_classes(rows, k), "vectors")
    known = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    if not known[0]:
        return classes.selectExpr("id AS query_id", "0 AS rank", "id AS vec_id", "0D AS score").limit(0)
    share = min(1.0, sample_rows / known[0])
    drawn = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(share * (1 << 30))
    sample = np.array([row.v for row in classes.where(drawn).select("v").toLocalIterator()], float)
    forest = fit_forest(
        sample.reshape(-1, width) if len(sample) else np.ones((1, width)), float(np.sqrt(known[1])), trees=trees,
        leaf=leaf, k=k, target=target,
    )
    found = _search(classes, forest, k, known[0])
    asked = rows.where("asked").select(F.col("id").alias("query_id"), "v")
    names = classes.where("asked").select("class", "v")
    lists = asked.join(names, "v").join(found, "class").select(
        "query_id", F.filter("near", lambda x: x["id"] != F.col("query_id")).alias("near")
    ).withColumn("near", F.flatten(F.transform("near", lambda x: F.array_repeat(x, x["n"]))))
    ranked = lists.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """``class, v, ids, asked, id``: distinct vectors, each with its ``k + 1`` smallest ids and their rows, up to ``k``.

    Batches keep only the smallest ids of a vector, counted, before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            kinds: dict[bytes, dict[object, list[int]]] = {}
            for i, v in enumerate(batch.column(1)):
                kinds.setdefault(v.values.to_numpy().tobytes(), {}).setdefault(ids[i], []).append(i)
            kept = []  # place, rows, whether the vector is asked for
            for places in kinds.values():
                mark = any(asked[i] for same in places.values() for i in same)
                kept += [(places[one][0], min(k, len(places[one])), mark) for one in sorted(places)[: k + 1]]
            kept.sort()
            part = batch.take(pa.array([i for i, *_ in kept], pa.int64()))
            counts, marks = pa.array([n for _, n, _ in kept], pa.int32()), pa.array([m for *_, m in kept], pa.bool_())
            yield pa.RecordBatch.from_arrays([*part.columns[:2], counts, marks], names=["id", "v", "n", "asked"])

    id_type = rows.schema["id"].dataType.simpleString()
    few = rows.mapInArrow(run, f"id {id_type}, v array<double>, n int, asked boolean")
    kinds = few.groupBy("v").agg(F.collect_list(F.struct("id", "n")).alias("all"), F.max("asked").alias("asked"))
    smallest = F.slice(F.array_sort(F.array_distinct("all.id")), 1, k + 1)

    def counted(one: Column) -> Column:
        same = F.filter("all", lambda x: x["id"] == one)
        n = F.aggregate(same, F.lit(0), lambda n, x: F.least(n + x["n"], F.lit(k)))
        return F.struct(one.alias("id"), n.alias("n"))

    kinds = kinds.select("v", F.transform(smallest, counted).alias("ids"), "asked")
    return kinds.select(F.monotonically_increasing_id().alias("class"), "v", "ids", "asked", F.col("ids")[0]["id"].alias("id"))


def _search(classes: DataFrame, forest: Forest, k: int, n: int) -> DataFrame:
    """``class, near``: for each asked class the nearest ids found, ``far`` being the negative score.

    ``at`` is the class that has the id, ``n`` its rows.
    """
    together = max(1, BLOCK_VECTORS * 2**forest.depth // n)  # leaves of a block
    salts = max(1, -(-n // (BLOCK_VECTORS * 2**forest.depth)))  # parts of a leaf larger than a block
    sent = classes.sparkSession.sparkContext.broadcast(forest)
    id_type = classes.schema["id"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1))
            if len(vectors):
                leaves = sent.value.leaves(vectors)
                lists = pa.array(list(leaves), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "leaves"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for step in range(0, batch.num_rows, 512):
                part = batch.slice(step, 512)
                for c, v, order in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sent.value.probed(_matrix(part.column(1)))):
                    blocks: dict[tuple[int, int], list[int]] = {}
                    for t, leaf in order:
                        blocks.setdefault((t, leaf // together), []).append(leaf)
                    rows += [(c, v, t, b, leaves) for (t, b), leaves in blocks.items()]
            names = ["class", "v", "tree", "block", "leaves"]
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=names)

    indexed = classes.select("class", "v", "ids").mapInArrow(index, f"class long, v array<double>, ids array<struct<id: {id_type}, n: int>>, leaves array<int>")
    indexed = indexed.select("class", "v", "ids", F.pmod(F.xxhash64("class"), F.lit(salts)).alias("salt"), F.posexplode("leaves").alias("tree", "leaf"))
    indexed = indexed.withColumn("block", F.floor(F.col("leaf") / together).cast("int"))
    asked = classes.where("asked").select("class", "v")
    asked = asked.mapInArrow(probe, "class long, v array<double>, tree int, block int, leaves array<int>")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    schema = f"class long, near array<struct<far: double, id: {id_type}, at: long, n: int>>"

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = block_nearest(left, right, k)
        kind = left.schema.field("ids").type.value_type.field("id").type
        near = pa.list_(pa.struct([("far", pa.float64()), ("id", kind), ("at", pa.int64()), ("n", pa.int32())]))
        return pa.table({"class": pa.array([c for c, _ in found], pa.int64()), "near": pa.array([x for _, x in found], near)})

    keys = ["tree", "block", "salt"]
    parts = indexed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare, schema)
    best = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))
    return parts.groupBy("class").agg(F.slice(best, 1, k + 1).alias("near"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten(), float)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)


def block_nearest(index: pa.Table, queries: pa.Table, k: int) -> list[tuple[int, list[dict]]]:
    """For each query row, the ``k + 1`` nearest ids among the vectors of its leaves."""
    if not index.num_rows or not queries.num_rows:
        return []
    leaf = index.column("leaf").to_numpy()
    order = np.argsort(leaf, kind="stable")
    leaf, vectors = leaf[order], _matrix(index.column("v").combine_chunks())[order]
    ids, classes = index.column("ids").to_pylist(), index.column("class").to_pylist()
    asked = _matrix(queries.column("v").combine_chunks())
    lists = queries.column("leaves").to_pylist()
    users: dict[int, list[int]] = {}
    for q, leaves in enumerate(lists):
        for one in leaves:
            users.setdefault(one, []).append(q)
    scores: list[list[np.ndarray]] = [[] for _ in lists]
    places: list[list[np.ndarray]] = [[] for _ in lists]
    for one, who in users.items():
        first, last = np.searchsorted(leaf, [one, one + 1])
        if first < last:
            found = asked[who] @ vectors[first:last].T
            most = min(k + 8, last - first)
            best = np.argpartition(-found, most - 1, axis=1)[:, :most]
            for row, q in enumerate(who):
                scores[q].append(found[row, best[row]])
                places[q].append(best[row] + first)
    result = []
    for q, c in enumerate(queries.column("class").to_pylist()):
        if not places[q]:
            continue
        at = np.concatenate(places[q])
        at = at[np.argsort(-np.concatenate(scores[q]), kind="stable")[: k + 8]]
        exact = np.zeros(len(at))
        for d in range(asked.shape[1]):  # one order of sums everywhere, so equal vectors score equal
            exact += asked[q, d] * vectors[at, d]
        found = zip(exact.tolist(), order[at].tolist())
        near = sorted((-s, i["id"], classes[p], i["n"]) for s, p in found for i in ids[p])
        result.append((c, [dict(zip(("far", "id", "at", "n"), x)) for x in near[: k + 1]]))
    return result
