"""BPE, decontamination, line quality and the n-gram join against plain versions."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from cloakwork.llm import bpe, decontaminate, line_crf, ngram_join, queries
from cloakwork.llm.common import text_bytes

from .helpers import empty_documents, odd_documents, odd_texts, words


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


def reference(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


def test_perfect_hash_is_minimal(vocabulary):
    table, ranks = vocabulary.hashed
    hashes = bpe.byte_hashes(*bpe._joined(vocabulary.tokens))
    assert sorted(table.places(hashes).tolist()) == list(range(len(hashes)))
    assert ranks[table.places(hashes)].tolist() == list(range(len(hashes)))


def test_encoding_equals_the_library(vocabulary):
    rng = random.Random(1)
    texts = ["", None, "  a\n\n b  ", "'S're it's", "a" * 4000, "<|endoftext|>", "日本 ١٢ ²½", "\x1c\x85\xa0z"]
    texts += ["".join(rng.choice(" \n\t'sabÉß²½\xa0ɏɐ日1२") for _ in range(80)) for _ in range(100)]
    encoder, library = bpe.Encoder(vocabulary), reference(vocabulary)
    ids, places = encoder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[places[i] : places[i + 1]].tolist() == library.encode_ordinary(text or "")


def test_round_trip(spark, vocabulary):
    coded = bpe.decode_ids(bpe.encode_texts(odd_documents(spark), vocabulary), vocabulary)
    rows = coded.select("doc_id", "text", "ids", "decoded").collect()
    assert len(rows) == len(odd_texts())
    assert all(bytes(row.decoded).decode() == (row.text or "") for row in rows)
    assert coded.columns.count("ids") == 1 and "Decoded" not in coded.columns
    assert bpe.encode_texts(empty_documents(spark), vocabulary).count() == 0


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(docs, items):
    windows = {}
    for item, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    result = []
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        result.append((doc, len(w), len(hit), sorted(found)))
    return sorted(result, key=repr)


@pytest.mark.parametrize("most", [decontaminate.MOST_BYTES, 600])
def test_decontamination_equals_a_plain_search(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BYTES", most)
    rng = random.Random(2)
    items = [(i, words(rng, rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(30)]
    items += [(99, None), (98, items[7][1]), (7, items[8][1]), (97, "É-x Ñ")]
    docs = [(i, words(rng, 20) + "; " + (rng.choice(items)[1] or "").upper() + ". " + words(rng, 20)) for i in range(60)]
    docs += [(row[0], row[1]) for row in odd_texts()] + [(500, "é x ñ É-X--Ñ")]
    found = decontaminate.find_items(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    rows = found.select("doc_id", "n_words", decontaminate.hit_words().alias("n"), "items", "text", "hits").collect()
    got = sorted([(r.doc_id, r.n_words, r.n, sorted(r["items"])) for r in rows], key=repr)
    assert got == plain_hits(docs, items)
    for row in rows:
        for hit in row.hits:
            inside = item_words(row.text[hit.start : hit.end])
            assert inside == item_words(row.text)[hit.first_word : hit.last_word + 1]


def test_decontamination_of_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(odd_documents(spark), none).where("size(hits) > 0").count() == 0
    assert decontaminate.find_items(empty_documents(spark), none).count() == 0


def test_quality_of_held_out_documents(spark, small):
    scored = queries.op8_line_crf(spark, "/root/testdata/sf0.01")
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert sum(row.predicted == row.quality for row in rows) >= 0.95 * len(rows)
    assert all(row.predicted == 1 for row in rows if row.quality == 1)
    for row in scored.limit(50).collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)


def test_marginals_equal_an_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    model = line_crf.LineModel(rng.normal(size=line_crf.N_FEATURES), rng.normal(size=(2, 2)))
    x = rng.normal(size=(5, line_crf.N_FEATURES)) / 4
    total, good = 0.0, np.zeros(5)
    for labels in itertools.product((0, 1), repeat=5):
        score = sum(x[i] @ model.weights for i in range(5) if labels[i])
        weight = np.exp(score + sum(model.links[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        good += weight * np.array(labels)
    assert np.allclose(model.marginals(x), good / total)


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0), (6, 0), (4, 1), (4, 1), (8, 7)], "doc_id long, quality int")
    model = line_crf.fit_quality(odd_documents(spark), labels)
    rows = line_crf.score_quality(odd_documents(spark), model).collect()
    assert len(rows) == len(odd_texts()) and all(0 <= row.score <= 1 for row in rows)
    unknown = line_crf.fit_quality(empty_documents(spark), labels.limit(0))
    assert line_crf.score_quality(empty_documents(spark), unknown).count() == 0


def plain_components(docs, k, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])

    sets = [shingles(text) for _, text in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted([(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)], key=repr)


@pytest.mark.parametrize("k, percent, block", [(4, 85, 128), (5, 80, 16)])
def test_links_equal_all_pairs(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    rng = random.Random(5)
    docs = [(row[0], row[1]) for row in odd_texts() if len(row[1] or "") < 10_000]
    line = words(rng, 12)
    for g in range(4):
        base = words(rng, 120).split()
        for i in range(40):
            rate = rng.choice([0, 0.005, 0.02, 0.04, 0.2])
            docs.append((1000 * g + 100 + i, " ".join(words(rng, 1) if rng.random() < rate else w for w in base)))
    docs += [(9000 + i, words(rng, rng.randint(2, 40)) + " " + line) for i in range(80)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    linked = ngram_join.link_documents(table, words=k, percent=percent)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in linked.collect()], key=repr)
    expected = plain_components(docs, k, percent)
    assert got == expected
    kept = ngram_join.keep_one_each(table, words=k, percent=percent)
    with_words = [(d, c) for d, n, c in expected if n]
    kept = sorted((r.doc_id for r in kept.where("text RLIKE '[^ \\t\\n]'").collect()), key=repr)
    assert kept == sorted({c for _, c in with_words}, key=repr)


def test_links_of_odd_tables(spark):
    linked = ngram_join.link_documents(odd_documents(spark))
    assert linked.count() == len(odd_texts()) and linked.where("component_id IS NULL AND doc_id IS NOT NULL").count() == 0
    assert ngram_join.link_documents(empty_documents(spark)).count() == 0
    odd = odd_documents(spark)
    kept = ngram_join.keep_one_each(odd)
    assert kept.columns == odd.columns
    rows = [tuple(row) for row in kept.collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= {tuple(row) for row in odd.collect()}
    assert sorted(row[0] for row in rows if row[0] is not None and (row[1] or "").split()) == [3, 4, 5, 6, 7, 10]
    assert sum(not (row[1] or "").split() for row in rows) == 4
    assert ngram_join.keep_one_each(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_filter_of_texts_loses_none(spark, monkeypatch, words):
    monkeypatch.setattr(ngram_join, "FILTER_WORDS", words)
    rows = spark.range(3000).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS key", "id", "id AS word")
    wanted = rows.where("id % 10 = 0").select("key")
    left = ngram_join._likely(rows, "key", wanted)
    assert left.columns == rows.columns
    assert left.where("id % 10 = 0").count() == 300
    assert left.count() < 320 or words == 1
    assert ngram_join._likely(rows, "key", wanted.limit(0)).count() == 0


def test_no_query_cuts_its_table(spark, small):
    n = queries.table(spark, small, "documents").count()
    for name in ("op2_bpe", "op4_ngram_join", "op8_line_crf", "op10_decontaminate"):
        rows = queries.QUERIES[name](spark, small)
        assert rows.count() == n and rows.select(F.countDistinct("doc_id")).first()[0] == n


def test_shingles_of_a_batch_take_little_memory():
    rng = random.Random(3)
    texts = pa.array([None, "", "one", *(words(rng, 400) for _ in range(1000)), words(rng, 300_000)]).slice(1)
    none, peaks, found = np.zeros(0, np.uint64), [], []
    for part in (texts, texts.slice(0, 1002)):
        tracemalloc.start()
        found.append(ngram_join.stepped_sets(part, 5, none))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 30e6
    whole = ngram_join.shingle_sets(*text_bytes(texts), 5, none)
    assert [s.tolist() for s in found[0]] == [s.tolist() for s in whole]
