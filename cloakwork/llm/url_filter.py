"""URLs allowed or blocked: by rules of host and path, else by a logistic regression on n-grams.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
the path goes on from there up to ``?``, ``#`` or the end. A URL that is NULL or has no ``://`` has
an empty host and path. A rule fits its host and all its subdomains, where the path starts with the
rule's; the longest rule decides, and block wins between two of one length. Where no rule fits, the
regression decides: its features are hashed character n-grams of host and path with marks at their
ends, its labels a small table of URLs (``urls.tsv``), in which endings and subdomains are spread over
both labels, so that the names decide. An empty host and path have no n-grams, so the offset decides.

Rules are settings: they become conditions of one projection. NULL and repeated URLs keep their rows.
"""

from __future__ import annotations

import pathlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, column, kept_columns, text_bytes

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIZES = (3, 4, 5)
BUCKETS = 1 << 16

#: 199 URLs of general kinds, 1 for wanted: what the regression learns from.
LABELLED = pathlib.Path(__file__).with_name("urls.tsv")


def labelled_urls(path: pathlib.Path = LABELLED) -> list[tuple[str, int]]:
    """A small table of URLs, 1 for wanted, one in each line after its label and a tab."""
    lines = (line.split("\t", 1) for line in path.read_text("utf-8").splitlines() if line)
    return [(url, int(label)) for label, url in lines]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    offset: float

    def scores(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log-odds of being wanted, for texts ``^host$^path$``."""
        found = np.full(len(places) - 1, self.offset)
        owners, buckets = ngrams(data, places)
        np.add.at(found, owners, self.weights[buckets])
        return found


def ngrams(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of every n-gram of every text."""
    owners, buckets = [], []
    owner = np.repeat(np.arange(len(places) - 1), np.diff(places))
    for size in SIZES:
        if len(data) < size:
            continue
        h = np.full(len(data) - size + 1, size, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + data[i : len(data) - size + 1 + i] + np.uint64(1)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[size - 1 :]
        owners.append(owner[: len(h)][inside])
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


def _marked(host: str, path: str) -> bytes:
    return f"^{host}$^{path}$".encode()


def fit_urls(table: Sequence[tuple[str, str, int]], rounds: int = 600, decay: float = 0.001, rate: float = 1.0) -> UrlModel:
    """Logistic regression on ``host, path, label`` rows, by full gradient steps.

    Texts are scaled by their number of n-grams only in the fit's step, not in the score, so that a
    URL of unknown n-grams gets the offset. The offset is a half: a URL is wanted unless shown
    otherwise. An empty table leaves every URL wanted.
    """
    weights, offset = np.zeros(BUCKETS), 0.5
    if not table:
        return UrlModel(weights, offset)
    texts = [_marked(host, path) for host, path, _ in table]
    data = np.frombuffer(b"".join(texts), np.uint8)
    places = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    owners, buckets = ngrams(data, places)
    y = np.array([label for *_, label in table], float)
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # both kinds weigh alike
    for _ in range(rounds):
        z = np.full(len(y), offset)
        np.add.at(z, owners, weights[buckets])
        slope = (y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * each
        step = np.bincount(buckets, slope[owners], BUCKETS)
        weights += rate * (step - decay * weights)
    return UrlModel(weights, offset)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def judge_urls(pages: DataFrame, rules: Sequence[Rule], model: UrlModel, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` (probability of wanted) and ``verdict``."""
    kept = kept_columns(pages, ["host", "path", "rule", "score", "verdict"])
    own = pages.select(*map(column, kept), column(url).alias("_url"))
    own = own.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))}).drop("_url")
    host, path = F.col("host"), F.col("path")
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.allow))
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for one in reversed(ordered):
        fits = ((host == one.host) | F.endswith(host, F.lit("." + one.host))) & F.startswith(path, F.lit(one.path))
        rule = F.when(fits, F.lit(one.name)).otherwise(rule)
        by_rule = F.when(fits, F.lit(one.allow)).otherwise(by_rule)
    marked = F.when((host == "") & (path == ""), F.lit("")).otherwise(F.concat(F.lit("^"), host, F.lit("$^"), path, F.lit("$")))
    own = own.withColumns({"rule": rule, "_rule": by_rule, "_marked": marked})
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(1 / (1 + np.exp(-np.clip(sent.value.scores(*text_bytes(texts)), -700, 700))))]

    scored = add_columns(own, "_marked", [T.StructField("score", T.DoubleType())], compute, drop=True)
    allowed = F.coalesce(F.col("_rule"), F.col("score") >= 0.5)
    return scored.withColumn("verdict", F.when(allowed, "allow").otherwise("block")).drop("_rule")


def fit_labelled(urls: DataFrame, url: str = "url", label: str = "label", max_rows: int = 100_000) -> UrlModel:
    """The regression for a table of labelled URLs, which the driver reads.

    Of more than ``max_rows`` different rows those with the smallest hashes are taken, whatever their
    order. Labels other than 0 and 1 take no part.
    """
    rows = urls.select(host_of(column(url)).alias("h"), path_of(column(url)).alias("p"), column(label).alias("y"))
    rows = rows.where("y IN (0, 1)").distinct().orderBy(F.xxhash64("h", "p", "y"), "h", "p", "y").limit(max_rows)
    return fit_urls(sorted((row.h, row.p, row.y) for row in rows.collect()))
