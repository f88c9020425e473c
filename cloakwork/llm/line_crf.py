"""Quality of documents by a conditional random field over their lines.

Every line of a text is good or bad. A line is described by shares of kinds of characters, its
length, its words, whether it occurs again in the text, and by the same figures of the lines before
and after it. A linear chain over the two labels is fitted to documents whose quality is known (all
lines of a document have its label); forward-backward gives every line its probability of being
good. Their mean, weighted by the lines' bytes, is a document's figure; a logistic curve fitted to
the same sample turns it into the document's probability of being good, which is its score.

The fit uses a sample of at most ``max_documents`` labelled documents (in expectation) of at most
``max_lines`` lines. Scores use the whole text. NULL counts as an empty text, which is one empty
line. Labels other than 0 and 1, and NULL, are left out of the fit; repeated labels all count.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, column, text_bytes

_KINDS = np.full(256, 7)  # 7: beyond ASCII
_KINDS[:128] = 5  # other signs
_KINDS[97:123] = 0
_KINDS[65:91] = 1
_KINDS[48:58] = 2
_KINDS[[9, 11, 12, 13, 32]] = 3
_KINDS[[ord(c) for c in ".,;:'\"()-"]] = 4
_KINDS[[ord(c) for c in "|<>{}[]\\/=_"]] = 6
_N_KINDS = 8
#: Figures of one line: shares of kinds, length, words, distinct words, word length, repeated line.
_OWN = _N_KINDS + 5
N_FEATURES = 3 * _OWN + 3


def line_features(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts; bytes of each line; where each text's lines begin and end."""
    n = len(places) - 1
    with_ends = np.insert(data, places[1:], 10)  # a line end after each text, so that no line is lost
    shifted = places + np.arange(n + 1)
    ends = np.flatnonzero(with_ends == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    bounds = np.searchsorted(starts, shifted)
    sizes = ends - starts
    kinds = _KINDS[with_ends]
    line = np.repeat(np.arange(len(starts)), sizes + 1)
    counts = np.bincount(line * _N_KINDS + kinds, minlength=len(starts) * _N_KINDS)
    counts = counts.reshape(-1, _N_KINDS).astype(float)
    counts[:, 5] -= 1  # the line end itself
    own = np.zeros((len(starts), _OWN))
    size = np.maximum(sizes, 1)
    own[:, :_N_KINDS] = counts / size[:, None]
    raw = with_ends.tobytes()
    for t in range(n):
        seen: dict[bytes, int] = {}
        for i in range(bounds[t], bounds[t + 1]):
            one = raw[starts[i] : ends[i]]
            words = one.split()
            own[i, _N_KINDS + 1] = len(words)
            own[i, _N_KINDS + 2] = len(set(words))
            if one in seen:
                own[i, _N_KINDS + 4] = own[seen[one], _N_KINDS + 4] = 1
            seen[one] = i
    words = np.maximum(own[:, _N_KINDS + 1], 1)
    own[:, _N_KINDS + 3] = np.minimum(sizes / words, 40) / 10
    own[:, _N_KINDS + 2] /= words
    own[:, _N_KINDS + 1] = np.log1p(words) / 5
    own[:, _N_KINDS] = np.log1p(sizes) / 8
    first, last = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    first[bounds[:-1]], last[bounds[1:] - 1] = True, True
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    edges = np.stack([np.ones(len(starts)), first, last], 1)
    return np.concatenate([own, before, after, edges], 1), size, bounds


@dataclass(frozen=True)
class LineModel:
    """``weights`` of the label good against bad, and the 2 x 2 ``links`` of neighbouring labels.

    ``curve`` holds slope and offset of the logistic curve from the lines' mean to the score.
    """

    weights: np.ndarray
    links: np.ndarray
    curve: tuple[float, float] = (4.0, -2.0)

    def document(self, features: np.ndarray, sizes: np.ndarray) -> tuple[float, np.ndarray]:
        """Score of a text and its lines' probabilities of good."""
        lines = self.marginals(features)
        slope, offset = self.curve
        return float(1 / (1 + np.exp(-(slope * np.average(lines, weights=sizes) + offset)))), lines

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Probability of good for each line of one text."""
        n = len(features)
        good = np.exp(np.clip(features @ self.weights, -30, 30))
        (bb, bg), (gb, gg) = np.exp(self.links).tolist()
        ahead, scores = [], good.tolist()
        b, g = 1.0, scores[0]
        for i in range(n):
            if i:
                b, g = b * bb + g * gb, (b * bg + g * gg) * scores[i]
            b, g = b / (b + g), g / (b + g)
            ahead.append((b, g))
        result = np.empty(n)
        b, g = 1.0, 1.0
        for i in range(n - 1, -1, -1):
            fb, fg = ahead[i]
            result[i] = fg * g / (fb * b + fg * g)
            nb, ng = b, g * scores[i]
            b, g = bb * nb + bg * ng, gb * nb + gg * ng
            b, g = b / (b + g), g / (b + g)
        return result


def fit_lines(texts: list[np.ndarray], labels: list[int], rounds: int = 250, decay: float = 0.002) -> LineModel:
    """Fits the chain to the features of texts by Adam steps on the mean log-likelihood of a text."""
    groups = []
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for part in np.array_split(np.array(order, int), max(1, len(order) // 64)):
        if not len(part):
            continue
        most = max(len(texts[i]) for i in part)
        x = np.zeros((len(part), most, N_FEATURES))
        mask = np.zeros((len(part), most))
        for k, i in enumerate(part):
            x[k, : len(texts[i])], mask[k, : len(texts[i])] = texts[i], 1
        groups.append((x, mask, np.array([labels[i] for i in part], float)))
    weights, links = np.zeros(N_FEATURES), np.zeros((2, 2))
    means = [np.zeros(N_FEATURES), np.zeros((2, 2))]
    squares = [np.zeros(N_FEATURES), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        slope = [-decay * weights, -decay * links]
        for x, mask, y in groups:
            for total, more in zip(slope, _slope(x, mask, y, weights, links)):
                total += more / max(1, len(texts))
        for k, value in enumerate((weights, links)):
            means[k] = 0.9 * means[k] + 0.1 * slope[k]
            squares[k] = 0.999 * squares[k] + 0.001 * slope[k] ** 2
            value += 0.1 * means[k] / (1 - 0.9**step) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)
    return LineModel(weights, links)


def fit_curve(values: np.ndarray, labels: np.ndarray, decay: float = 0.01) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps; the slope is never below zero."""
    x = np.stack([values, np.ones_like(values)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        curvature = (x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(2)
        w += np.linalg.solve(curvature, x.T @ (labels - p) - decay * w)
    return max(float(w[0]), 0.0), float(w[1])


def _slope(x, mask, y, weights, links):
    """Slope of the log-likelihood: what is observed less what the chain expects."""
    n, most, _ = x.shape
    score = np.stack([np.zeros((n, most)), np.clip(x @ weights, -30, 30)], 2)
    ahead, back = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    ahead[:, 0] = score[:, 0]
    for i in range(1, most):
        ahead[:, i] = np.logaddexp.reduce(ahead[:, i - 1, :, None] + links, 1) + score[:, i]
    for i in range(most - 2, -1, -1):
        later = back[:, i + 1] + score[:, i + 1]
        here = np.logaddexp.reduce(links + later[:, None, :], 2)
        back[:, i] = np.where(mask[:, i + 1, None] > 0, here, 0)
    joint = ahead + back
    total = np.logaddexp.reduce(joint, 2, keepdims=True)
    good = np.exp(joint - total)[:, :, 1]
    slope = np.einsum("nl,nlf->f", mask * (y[:, None] - good), x)
    pair = ahead[:, :-1, :, None] + links + (score + back)[:, 1:, None, :] - total[:, 1:, :, None]
    both = (np.exp(pair) * mask[:, 1:, None, None]).sum((0, 1))
    seen = np.zeros((2, 2))
    pairs = mask[:, 1:].sum(1)
    seen[1, 1], seen[0, 0] = (pairs * y).sum(), (pairs * (1 - y)).sum()
    return slope, seen - both


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from the fit: CRC-32 of its id as text leaves 1 by 3."""
    return F.crc32(F.coalesce(column(doc_id).cast("string"), F.lit(""))) % 3 == 1


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_documents: int = 4000,
    max_lines: int = 1000,
    text: str = "text",
    doc_id: str = "doc_id",
    quality: str = "quality",
) -> LineModel:
    """A model of the labelled documents that are not held out.

    The sample is drawn by a hash of the id, on both tables, so only it is joined. Without labels
    of both kinds the model knows nothing and scores every line by half.
    """
    known = labels.select(column(doc_id).alias("id"), column(quality).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id"))
    share = min(1.0, max_documents / max(1, known.count()))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(8)), F.lit(1_000_000)) < int(share * 1_000_000)
    texts = docs.select(column(doc_id).alias("id"), column(text).alias("text")).where(drawn)
    sample = texts.join(known.where(drawn), "id")

    def compute(batch: pa.Array) -> list[pa.Array]:
        features, sizes, bounds = line_features(*text_bytes(batch))
        rows = np.concatenate([features, sizes[:, None]], 1).astype("<f4")
        parts = [rows[a:b].tobytes() if b - a <= max_lines else None for a, b in zip(bounds[:-1], bounds[1:])]
        return [pa.array(parts, pa.binary())]

    fields = [T.StructField("lines", T.BinaryType())]
    rows = add_columns(sample, "text", fields, compute, drop=True).where("lines IS NOT NULL")
    rows = sorted(rows.select("id", "label", "lines").collect(), key=lambda row: (str(row.id), row.label, row.lines))
    found = [np.frombuffer(row.lines, "<f4").reshape(-1, N_FEATURES + 1).astype(float) for row in rows]
    y = [row.label for row in rows]
    if len(set(y)) < 2:
        return LineModel(np.zeros(N_FEATURES), np.zeros((2, 2)))
    model = fit_lines([one[:, :-1] for one in found], y)
    means = [np.average(model.marginals(one[:, :-1]), weights=one[:, -1]) for one in found]
    return replace(model, curve=fit_curve(np.array(means), np.array(y, float)))


def score_quality(docs: DataFrame, model: LineModel, text: str = "text", keep_lines: bool = True) -> DataFrame:
    """``docs`` with ``score`` and, if asked for, ``line_scores``: the probability of good per line."""
    fields = [T.StructField("score", T.DoubleType())]
    if keep_lines:
        fields.append(T.StructField("line_scores", T.ArrayType(T.FloatType())))

    def compute(batch: pa.Array) -> list[pa.Array]:
        features, sizes, bounds = line_features(*text_bytes(batch))
        found = [model.document(features[a:b], sizes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        new = [pa.array([score for score, _ in found], pa.float64())]
        if keep_lines:
            new.append(pa.array([lines for _, lines in found], pa.list_(pa.float32())))
        return new

    return add_columns(docs, text, fields, compute)
