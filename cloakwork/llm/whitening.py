"""Embedding whitening: Golub-Kahan-Lanczos bidiagonalisation of centred vectors, in Spark scans.

Entries are put on a grid: ``x = floor(scale * c) + shift``, a long. The fit list is each distinct x
vector once; ``n`` vectors with sums ``S`` per dimension. Its centred rows, ``(n * x - S) / n`` over
the square root of n, are the matrix X. One scan per step multiplies in both directions: a task forms
its rows' entries of ``u = Xv - beta * u_before`` and adds up its share of ``X'u``, of ``U'u`` for all
earlier left vectors U, and of ``u'u``. What u has in common with U is then taken out of ``X'u`` too,
which is linear; right vectors are made orthogonal to all earlier ones on the driver, twice. So both
sides are reorthogonalised in full, and nothing as long as the table is ever held: a left vector is
``X`` times a vector of one entry per dimension. Each scan returns one number per dimension and step.

The singular values and right vectors of the small bidiagonal matrix give eigenvalues and components.
Steps end when the leading triples have converged to rounding, and at the number of dimensions. Where
the iteration breaks down (repeated eigenvalues, dependent dimensions) it goes on with a new direction
orthogonal to all others. Components of eigenvalue zero do not exist: there are at most as many as the
fit list has independent directions, none where all vectors are equal.

Dropped are rows whose vector is NULL, empty, or holds a NULL or non-finite entry, or one of at least
2**34, which has no exact deviation in a long; and vectors of another length than most (of two lengths
equally frequent, the larger stays). Repeated rows count once in the fit and get a result each. An empty
table gives no rows. A deviation that does not fit a long is NULL. Columns named like result columns are
replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import column, kept_columns

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries of this size and more have no exact deviation in a long.
_TOO_LARGE = float(2**34)
_EPS = float(np.finfo(np.float64).eps)
_SAFE = 2**62
#: Vectors that one numpy step multiplies.
_STEP = 4096


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: ``components`` has a column per component, ``values`` their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    steps: int

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def grid_rows(df: DataFrame, vector: str, scale: int, shift: int) -> DataFrame:
    """``df`` with ``x array<bigint>``, without the rows that take no part."""
    fine = F.forall(
        column(vector),
        lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < _TOO_LARGE), F.lit(False)),
    )
    x = F.transform(column(vector), lambda c: F.floor(c.cast("double") * scale) + F.lit(shift))
    kept = kept_columns(df, ["x"])
    usable = df.where(F.coalesce(fine & (F.size(column(vector)) > 0), F.lit(False)))
    return usable.select(*map(column, kept), x.cast("array<bigint>").alias("x"))


def _matrix(x: pa.Array) -> np.ndarray:
    return np.asarray(x.flatten(), dtype=np.int64).reshape(len(x), -1)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S`` without rounding: as longs where they fit, else as Python integers."""
    if max(int(np.abs(x).max(initial=0)) * n, int(np.abs(sums).max(initial=0))) < _SAFE:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def _sums(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """Sums over the fit list of the ``size`` numbers that ``part`` derives from a block of vectors.

    Tasks add up their blocks, Spark the tasks' sums.
    """
    dtype = np.float64 if kind == "double" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            for start in range(0, batch.num_rows, _STEP):
                total += part(_matrix(batch.column(0).slice(start, _STEP)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "part"])

    rows = fit.mapInArrow(run, f"place int, part {kind}").groupBy("place").agg(F.sum("part").alias("total")).collect()
    out = np.zeros(size, dtype)
    for row in rows:
        out[row.place] = row.total
    return out


def fit_whitening(
    df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> Whitening:
    """Components of the distinct grid vectors of a table."""
    lengths = grid_rows(df.select(column(vector).alias("v")), "v", scale, shift)
    common = lengths.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    nothing = Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    if common is None:
        return nothing
    d = common.d
    fit = stored(lengths.where(F.size("x") == d).select("x").distinct(), "whitening-fit")
    totals = _sums(fit, lambda x: np.append(x.sum(axis=0), len(x)), d + 1, "bigint")
    n, sums = int(totals[-1]), totals[:-1]

    def squares(x: np.ndarray) -> np.ndarray:
        return (_centred(x, n, sums) ** 2).sum(axis=0)

    trace = float(_sums(fit, squares, d).sum() / n)
    if trace == 0:
        return Whitening(n, tuple(map(int, sums)), np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0)

    def both_ways(earlier: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """``X'u``, ``U'u`` and ``u'u`` of ``u = X new`` and ``U = X earlier``."""
        both, size = np.column_stack([earlier, new]), d + earlier.shape[1] + 1

        def part(x: np.ndarray) -> np.ndarray:
            rows = _centred(x, n, sums)
            left = rows @ both
            return np.concatenate([left[:, -1] @ rows, left[:, -1] @ left])

        out = _sums(fit, part, size) / n
        return out[:d], out[d:-1], float(out[-1])

    values, right, steps = bidiagonalise(both_ways, d, trace, components)
    whiten = right / np.sqrt(values)
    k = len(values)

    def products(x: np.ndarray) -> np.ndarray:
        rows = _centred(x, n, sums) @ whiten
        return np.concatenate([(rows.T @ rows).ravel(), rows.sum(axis=0)])

    moments = _sums(fit, products, k * k + k) / n
    mean = moments[k * k :]
    covariance = moments[: k * k].reshape(k, k) - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(k)).max())
    return Whitening(n, tuple(map(int, sums)), right, values, trace, error, steps)


def bidiagonalise(
    both_ways: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], d: int, trace: float, wanted: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Leading eigenvalues of X'X, the eigenvectors as columns, and the steps taken.

    ``both_ways(earlier, new)`` multiplies with X, see :func:`fit_whitening`. ``trace`` is that of X'X.
    """
    nothing = 8 * d * _EPS * np.sqrt(trace)
    draw = np.random.default_rng(1)
    right, left, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    alphas: list[float] = []
    betas: list[float] = []
    v = _new_direction(draw, right)
    for step in range(1, d + 1):
        new = v - betas[-1] * left[:, -1] if betas else v
        product, common, square = both_ways(left, new)
        new, product = new - left @ common, product - back @ common
        alpha = float(np.sqrt(max(square - common @ common, 0.0)))
        if alpha <= nothing:  # Xv lies among the earlier left vectors
            alpha, new, product = 0.0, np.zeros(d), np.zeros(d)
        else:
            new, product = new / alpha, product / alpha
        alphas.append(alpha)
        right, left, back = (np.column_stack(pair) for pair in ((right, v), (left, new), (back, product)))
        rest = product
        for _ in range(2):
            rest = rest - right @ (right.T @ rest)
        beta = float(np.linalg.norm(rest))
        small = np.diag(alphas) + np.diag(betas, 1)
        q, values, zt = np.linalg.svd(small)
        if step == d or _converged(values, np.abs(q[-1]) * beta, wanted, nothing):
            break
        v = rest / beta if beta > nothing else _new_direction(draw, right)
        betas.append(beta if beta > nothing else 0.0)
    found = min(wanted, int((values > nothing).sum()))
    return values[:found] ** 2, right @ zt[:found].T, step


def _new_direction(draw: np.random.Generator, right: np.ndarray) -> np.ndarray:
    v = draw.standard_normal(len(right))
    for _ in range(2):
        v = v - right @ (right.T @ v)
    return v / np.linalg.norm(v)


def _converged(values: np.ndarray, residuals: np.ndarray, wanted: int, nothing: float) -> bool:
    """Whether the ``wanted`` leading vectors are as exact as rounding lets them be.

    A vector's error is its residual over the distance to the next value, so close values need more
    steps; one value more than wanted must have come close as well.
    """
    if len(values) <= wanted or residuals[wanted] > 1e-3 * values[wanted]:
        return False
    gaps = values[:-1] - values[1:]
    near = np.minimum(gaps, np.append(np.inf, gaps[:-1]))[:wanted]
    return bool(np.all(residuals[:wanted] <= 4 * _EPS * near + 1e-3 * _EPS * nothing))


def whiten(
    df: DataFrame, model: Whitening, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """``df`` with ``deviation``, squared distance from the mean in nths, and ``whitened``, an entry per component."""
    fields = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    kept = kept_columns(df, ["x", *[f.name for f in fields]])
    usable = grid_rows(df.select(*[column(c) for c in {*kept, vector}]), vector, scale, shift)
    rows = usable.where(F.size("x") == len(model.sums)).select(*map(column, kept), "x")
    schema = T.StructType(rows.schema.fields[:-1] + fields)
    n, sums = model.n, np.array(model.sums, np.int64)
    project, k = model.components / np.sqrt(model.values), len(model.values)
    last = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _STEP):
                part = batch.slice(start, _STEP)
                away = _deviations(_matrix(part.column(last)), n, sums)
                most = int(np.abs(away).max(initial=0))
                if most * most * len(sums) >= _SAFE:
                    away = away.astype(object)
                square = (away * away).sum(axis=1)
                exact = pa.array([s if s < 2**63 else None for s in square.tolist()], pa.int64())
                white = ((away / n).astype(np.float64) @ project).ravel()
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * k)
                arrays = [*part.columns[:last], exact, pa.ListArray.from_arrays(offsets, pa.array(white))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def whitened_rows(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component, numbered from 1, with the figures of the fit."""
    rows = whiten(df.select(column(key).alias("_key"), column(vector).alias("_vector")), model, "_vector")
    explained = F.from_json(F.lit(json.dumps(model.explained)), "array<double>")
    return rows.select("_key", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        F.col("_key").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
