"""Whitening, ranked search and packing against dense algebra, all pairs and exhaustive packing."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloakwork.llm import packing, ranked_search, whitening

from .helpers import empty_documents, odd_documents, words

# --- whitening -----------------------------------------------------------------------------------


def vectors(spark, rows, schema="vec_id long, embedding array<double>"):
    return spark.createDataFrame(rows, schema).repartition(3)


def dense(grid):
    """Distinct vectors, their sums, eigenvalues and vectors of the covariance, largest first."""
    x = np.unique(np.array(grid, np.int64), axis=0)
    sums = x.sum(axis=0)
    centred = (len(x) * x - sums) / len(x)
    values, right = np.linalg.eigh(centred.T @ centred / len(x))
    return x, sums, values[::-1], right[:, ::-1]


def grid(rows):
    return [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]


def test_whitening_of_the_given_vectors(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    found = whitening.whitened_rows(df, whitening.fit_whitening(df)).collect()
    given_rows = {r.vec_id: r.embedding for r in df.collect()}
    x, sums, values, right = dense(grid(given_rows.values()))
    n = len(x)
    assert len(found) == 16 * len(given_rows)
    signs = {}
    for row in found:
        away = [n * c - s for c, s in zip(grid([given_rows[row.vec_id]])[0], sums.tolist())]
        i = row.component - 1
        expected = float(np.dot(away, right[:, i])) / n / math.sqrt(values[i])
        sign = signs.setdefault(i, 1 if expected * row.whitened > 0 else -1)
        assert row.n == n and row.deviation == sum(a * a for a in away)
        assert row.whitened == pytest.approx(sign * expected, abs=1e-9)
        assert row.explained == pytest.approx(values[i] / values.sum(), rel=1e-9)
        assert row.identity_error < 1e-10


def test_odd_vectors(spark):
    plain = [[float(i % 5), float(i % 3), i / 7] for i in range(30)]
    odd = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [1.0, math.inf, 2.0], [2.0**34, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "a", "b", "c") for i, v in enumerate(plain + odd)] + [(3, plain[3], "a", "b", "c"), (None, plain[4], "d", None, "e")]
    df = vectors(spark, rows, "vec_id long, embedding array<double>, x string, Deviation string, other string")
    model = whitening.fit_whitening(df)
    x, sums, values, _ = dense(grid(plain))
    assert model.n == len(x) and model.sums == tuple(sums.tolist())
    assert model.values == pytest.approx(values, rel=1e-9)
    out = whitening.whiten(df, model)
    assert sorted(out.columns) == ["deviation", "embedding", "other", "vec_id", "whitened"]
    kept = out.collect()
    assert Counter(r.vec_id for r in kept) == Counter([*range(30), 3, None])
    white = np.array([r.whitened for r in kept if r.vec_id is not None and r.vec_id < 30])
    first = {tuple(grid([r.embedding])[0]): r.whitened for r in kept}
    moments = np.array(list(first.values()))
    assert white.shape == (31, 3)
    assert np.abs(moments.T @ moments / len(moments) - np.eye(3)).max() < 1e-10


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([], 0),
        ([[1.0, 2.0]], 0),
        ([[1.0, 2.0]] * 4, 0),
        ([[0.0, 0.0], [1.0, 1.0]], 1),
        ([[i, i, i % 2, i % 2] for i in range(6)], 2),
        ([[float(i == j) for j in range(6)] for i in range(6)], 5),  # one value, five times
    ],
)
def test_as_many_components_as_directions(spark, rows, expected):
    df = vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(rows)])
    model = whitening.fit_whitening(df)
    out = whitening.whitened_rows(df, model).collect()
    assert len(model.values) == expected and len(out) == expected * len(rows)
    if expected:
        assert model.identity_error < 1e-10
        assert model.values == pytest.approx(dense(grid(rows))[2][:expected], rel=1e-9)


def test_deviation_beyond_a_long_is_null(spark):
    df = vectors(spark, [(0, [2.0**33]), (1, [-(2.0**33)]), (2, [0.0]), (3, [1.0])])
    found = {r.vec_id: r.deviation for r in whitening.whiten(df, whitening.fit_whitening(df)).collect()}
    assert found[0] is None and found[1] is None and found[3] == (4 * 64 - 64) ** 2


@pytest.mark.parametrize("spread", [0, 3, 6])
def test_bidiagonalisation_of_badly_scaled_matrices(spread):
    rng = np.random.default_rng(spread)
    x = rng.standard_normal((300, 24)) * 10.0 ** -np.linspace(0, spread, 24)

    def both_ways(earlier, new):
        u = x @ np.column_stack([earlier, new])
        return x.T @ u[:, -1], u[:, :-1].T @ u[:, -1], float(u[:, -1] @ u[:, -1])

    values, right, _ = whitening.bidiagonalise(both_ways, 24, float((x * x).sum()), 8)
    expected = np.linalg.svd(x)
    assert np.sqrt(values) == pytest.approx(expected[1][:8], rel=1e-10)
    assert np.abs(np.abs((right * expected[2][:8].T).sum(axis=0)) - 1).max() < 1e-10


# --- ranked search -------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def all_scores(docs, items, top=20):
    """Item's best documents, every pair scored."""
    texts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    texts = [(d, c) for d, c in texts if c]
    total = sum(sum(c.values()) for _, c in texts)
    frequent = Counter(term for _, c in texts for term in c)
    asked = defaultdict(Counter)
    for item, text in {(i, t) for i, t in items if i is not None and t is not None}:
        asked[item].update(TERM.findall(text.translate(LOWER)))
    out = set()
    for item, terms in asked.items():
        ranked = []
        for doc, counts in texts:
            m = 75 + 25 * sum(counts.values()) * len(texts) // total
            score = sum(
                k * math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * frequent[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m))
                for t, k in terms.items()
                if counts[t]
            )
            if score:
                ranked.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(ranked, key=lambda r: r[:3])[:top], 1):
            out.add((item, rank, doc, -score))
    return out


def test_search_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "MOST_BYTES", 40)
    monkeypatch.setattr(ranked_search, "MOST_PAIRS", 8)
    monkeypatch.setattr(ranked_search, "_FILE_ROWS", 6)
    docs = odd_documents(spark)
    rng = random.Random(1)
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(i, " ".join(rng.choices(pairs[7][1].split()[:40] if pairs[7][1] else ["ab"], k=6)) + " one É") for i in range(5)]
    items += [(5, None), (6, ""), (7, "?!"), (None, "one"), (8, "ONE one"), (8, "ONE one"), (8, "two"), (9, "日本 é ñ x"), (10, "nowhere")]
    asked = spark.createDataFrame([(*r, "n", "t") for r in items], "item_id long, text string, score string, Item string")
    found = ranked_search.search(docs, asked, top=3)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == all_scores(pairs, items, 3)


def test_search_with_ties_and_many_copies(spark):
    rng = random.Random(2)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(150)]
    texts += [texts[0]] * 300 + ["ab ab ab"] * 40
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(rng.choices(" ".join(texts[:20]).split(), k=12))) for i in range(12)] + [(50, texts[0]), (51, "ab")]
    found = ranked_search.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id int, text string")
    )
    assert {tuple(r) for r in found.collect()} == all_scores(docs, items)


def test_search_of_empty_tables(spark):
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    assert ranked_search.search(empty_documents(spark), some).isEmpty()
    assert ranked_search.search(docs, some.limit(0)).isEmpty()


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_bounds_lose_no_document(seed):
    rng = np.random.default_rng(seed)
    n, kinds = int(rng.integers(1, 40)), int(rng.integers(1, 12))
    table = rng.integers(0, 1000, (n, kinds)) * (rng.random((n, kinds)) < rng.random())
    rows = [np.flatnonzero(row) for row in table]
    ids = np.arange(n)
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(ids),
            pa.array(np.sqrt((table.astype(float) ** 2).sum(axis=1)) * ranked_search._SLACK),
            pa.array([r.tolist() for r in rows], pa.list_(pa.int32())),
            pa.array([table[i][r].tolist() for i, r in enumerate(rows)], pa.list_(pa.int64())),
        ],
        names=["doc_id", "length", "terms", "impacts"],
    )
    bucket = ranked_search.Bucket(batch)
    asked = np.flatnonzero(rng.random(kinds + 2) < 0.6)
    weights = rng.integers(1, 5000, len(asked))
    scores = np.array([sum(int(w) * int(table[i, t]) for t, w in zip(asked, weights) if t < kinds) for i in range(n)])
    length = float(np.sqrt((weights.astype(float) ** 2).sum())) * ranked_search._SLACK
    for least in {1, *np.quantile(scores, [0.3, 0.7, 0.9, 1]).astype(int).tolist()} - {0}:
        found, exact = bucket.search(asked, weights, length, least)
        assert set(found.tolist()) == set(np.flatnonzero(scores >= least).tolist())
        assert exact.tolist() == scores[found].tolist()


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 50])
def test_terms_across_parts_of_a_text(chunk, monkeypatch):
    monkeypatch.setattr(ranked_search, "_CHUNK", chunk)
    text = "One, two TWO  three—four é日本 " * 3 + "x" * 20
    terms = TERM.findall(text.translate(LOWER))
    known = {t.encode(): i for i, t in enumerate(["one", "two", "three—four", "x" * 20])}
    n, counts = ranked_search.count_terms(text.encode(), known)
    assert n == len(terms)
    assert counts == Counter(t.encode() for t in terms if t.encode() in known)


# --- packing -------------------------------------------------------------------------------------

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(FILE, encoding="utf-8") as file:
        return packing.Encoder(file.read())


def fewest(lengths, capacity):
    """Fewest sequences, by trying all ways."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def counted(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 30), st.data())
def test_reduction_keeps_the_fewest(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=9))
    fixed, left = packing.reduce_counts(counted(lengths, capacity), capacity)
    used = sum(times for _, times in fixed)
    taken = Counter()
    for kinds, times in fixed:
        assert sum(x * many for x, many in kinds) <= capacity
        taken.update({x: many * times for x, many in kinds})
    rest = [x for x, many in enumerate(left) for _ in range(many)]
    assert taken + Counter(rest) == Counter(lengths)
    assert used + fewest(rest, capacity) == fewest(lengths, capacity)


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 40), st.data())
def test_best_fit_by_classes_is_best_fit(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    rooms = []
    for x in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= x]
        room = min(fitting, default=capacity)
        if fitting:
            rooms.remove(room)
        rooms.append(room - x)
    groups = packing.best_fit(counted(lengths, capacity), capacity)
    found = [capacity - sum(x * many for x, many in kinds) for kinds, times in groups for _ in range(times)]
    assert sorted(found) == sorted(rooms)


def test_three_pieces_that_dominate():
    # beside 10 of 20: 6 and 4 fit exactly, nothing else goes between them
    assert packing.dominating_set(counted([10, 6, 4, 9, 3], 20), 10, 20) is None
    assert packing.dominating_set(counted([11, 5, 4, 4], 20), 11, 20) == (11, 5, 4)
    assert packing.dominating_set(counted([11, 9, 1, 1], 20), 11, 20) == (11, 9)
    assert packing.dominating_set(counted([19, 5], 20), 19, 20) == (19,)


def test_plan_places_each_number_once():
    rng = np.random.default_rng(3)
    counts = counted(rng.integers(1, 65, 5000), 64)
    plan = packing.plan_packing(counts, 64)
    used = sum(x * many * times for kinds, times in plan.patterns for x, many in kinds)
    assert used == int((counts * np.arange(65)).sum())
    assert plan.n_sequences <= math.ceil(used / 64) * 1.02


def test_ids_are_those_of_the_library(encoder):
    assert encoder.fast is not None
    texts = [chr(c).join(["a", "a 1", "1 .", ". ", "", "a"]) for c in itertools.chain(range(0xD800), range(0xE000, 0x10000, 3), range(0x10000, 0x110000, 997))]
    texts += ["", " ", "\n" * 7000 + "x", " " * 200_000, "x" * 5000, "<|endoftext|> a", "I'll we'RE 's", "a\u0085b c"]
    for start in range(0, len(texts), 5000):
        part = texts[start : start + 5000]
        expected = encoder.library.encode_batch(part, add_special_tokens=False)
        assert [encoder(t) for t in part] == [e.ids for e in expected]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(encoder, text):
    assert encoder(text) == encoder.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_files_go_through_the_library(name):
    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as file:
        found = packing.Encoder(file.read())
    assert bool(found.fast) == name.startswith("byte")
    assert found("Some words, 12") == Tokenizer.from_file(path).encode("Some words, 12", add_special_tokens=False).ids


def check_packing(rows, texts, encoder, capacity):
    expected = Counter()
    for doc_id, text in texts:
        whole = [*encoder.by_library(text or ""), 0]
        first = len(whole) % capacity or capacity
        edges = [0, *range(first, len(whole) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            expected[doc_id, piece, a, b - a, zlib.crc32(np.array(whole[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(x for _, x in parts[:-1])]
        assert sum(x for _, x in parts) <= capacity
    return places


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_packing_of_odd_documents(spark, encoder, capacity):
    docs = odd_documents(spark)
    texts = [(r.doc_id, (r.text or "")[: 40 * capacity]) for r in docs.collect()]
    short = spark.createDataFrame([(*r, "x", 1) for r in texts], "doc_id long, text string, Length string, task int").repartition(3)
    packed = packing.pack_documents(short, FILE, capacity=capacity)
    rows = packed.collect()
    places = check_packing(rows, texts, encoder, capacity)
    total = sum(r.length for r in rows)
    assert len(places) <= math.ceil(total / capacity) + 1
    whole = packing.sequences(packed).collect()
    assert sorted(r.sequence_id for r in whole) == sorted(places)
    assert sum(r.n_tokens for r in whole) == total and all(len(r.ids) == 4 * r.n_tokens for r in whole)


def test_packing_of_given_documents(spark, small, encoder):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack_documents(docs, FILE, ids=False).collect()
    places = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], encoder, 2048)
    assert len(places) <= math.ceil(sum(r.length for r in rows) / 2048) + 1  # 96 is a bound, not known to be reached


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(empty_documents(spark), FILE).isEmpty()
