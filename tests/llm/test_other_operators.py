"""Search, URLs, pages, repeats, passages, totals and the pipeline against plain versions."""

import contextlib
import hashlib
import inspect
import os
import pathlib
import random
import re
import threading
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakwork.llm import (
    ann_forest, chaining, components, decontaminate, html_consensus, ngram_join, queries, suffix_dedup, token_counts, url_filter,
)
from verification.compare import duckdb_over, normalized

from .helpers import empty_documents, odd_documents, odd_texts, words


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist(), "x") for i in range(600)]
    rows += [(1000 + i, [1.0] * 8, None) for i in range(200)]
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] + [1.0] * 7), (2080, [1.0, 2.0]), (None, [1.0] * 8), (2100, [])]
    rows += [(i, v, "score") for i, v in odd]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    found = {}
    for row in ann_forest.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
    usable = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows[:800]}
    asked = [i for i in usable if i % 20 == 0]
    assert sorted(found) == asked
    hits = 0
    for q in asked:
        true = sorted((-float(sum((usable[q] * v).tolist())), i) for i, v in usable.items() if i != q)[:20]
        assert [(-s, i) for i, s in found[q]] == sorted((-s, i) for i, s in found[q])
        hits += len({i for _, i in true} & {i for i, _ in found[q]})
    assert hits >= 0.9 * 20 * len(asked)
    assert [i for i, _ in found[1000]][:3] != [] and 1000 not in [i for i, _ in found[1000]]


def test_recall_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.table(spark, folder, "embeddings").collect()
    x, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    found = queries.op1_ann_forest(spark, folder).groupBy("query_id").agg(F.collect_set("vec_id").alias("near")).collect()
    hits = 0
    for row in found:
        scores = x @ x[ids.index(row.query_id)]
        scores[ids.index(row.query_id)] = -np.inf
        hits += len({ids[i] for i in np.argsort(-scores)[:20]} & set(row.near))
    assert hits >= 0.9 * 20 * len(found) and len(found) == 25


def test_search_in_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann_forest.nearest(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0])], empty.schema)
    assert ann_forest.nearest(one, F.lit(True)).count() == 0


def test_urls(spark):
    model = url_filter.fit_labelled(spark.createDataFrame(url_filter.labelled_urls(), "url string, label int"))
    cases = {
        "http://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://x.example.org/en/12#t": ("x.example.org", "/en/12", "example.org/en/1", "block"),
        "http://x.org/de": ("x.org", "/de", "org/", "allow"),
        "http://casino-win.example.com/fr/2": ("casino-win.example.com", "/fr/2", "com/fr/", "allow"),
        "https://blog.casino-win.example.net/en/3": ("blog.casino-win.example.net", "/en/3", None, "block"),
        "https://www.cheap-pills.example.net": ("www.cheap-pills.example.net", "", None, "block"),
        "https://m.thening.example.net/de/77.html": ("m.thening.example.net", "/de/77.html", None, "allow"),
        "http://notorg/x": ("notorg", "/x", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, url, "clash") for i, url in enumerate([*cases, None])]
    judged = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), queries.URL_RULES, model)
    for row in judged.collect():
        assert (row.host, row.path, row.rule, row.verdict) == cases[row.url], row.url
    assert judged.count() == len(rows)
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), [], model).count() == 0


def test_pages(spark):
    shell = "<html><body><nav><a href=x>Menu</a></nav><div class='story{}'>{}</div><div class=sidebar><p>{}</p></div></body>"
    story = "<h1>T&eacute;</h1><p>Some  text\nhere, <b>with</b> words<p>More<br>of it<div class='user-comments'><p>" + "Great! " * 60 + "</p></div>"
    pages = [(i, "http://h.org/1", shell.format(i, story, "Side " * 30), "x") for i in range(5)]
    pages += [(5, "http://h.org/2", "<p>cut &amp; of", "x"), (6, None, None, None), (7, "http://h.org/3", "", ""), (8, "http://o.org", "<script>x</script>", "y")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string").repartition(2)
    got = {row.page_id: row for row in html_consensus.extract_text(table).collect()}
    assert all(got[i].text == "Té\nSome text here, with words\nMore of it" for i in range(5))
    assert [got[i].text for i in (5, 6, 7, 8)] == ["cut & of", "", "", ""] and got[0].n_chars == len(got[0].text)
    assert html_consensus.extract_text(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>H</h1><div class=lead><p>{0}</p></div><div class=body><p>{1}</p></div></article>", "H\n{0}\n{1}"),
        ("<article><h1>H</h1><section><p>{1}</p></section><section><p>{0}</p></section></article>", "H\n{1}\n{0}"),
        ("<div class=post><h1>H</h1><p>{0}</p><ul><li>{1}</li></ul><blockquote><p>{1}</p></blockquote></div>", "H\n{0}\n{1}\n{1}"),
        ("<main><article><h1>H</h1><div><div><p>{1}</p></div></div><p>{0}</p></article><div class=related><p>{1}</p></div></main>", "H\n{1}\n{0}"),
    ],
)
def test_split_articles_are_whole(page, text):
    short, long = "s" * 100, "l" * 1000
    html = "<html><body><div class=top><p>Site</p></div>" + page.format(short, long) + "<footer>F</footer></body></html>"
    own = html_consensus._scores(html_consensus.parse(html))
    assert html_consensus.main_text(html, []) == text.format(short, long)
    assert html_consensus.main_text(html, sorted(own, key=lambda p: -own[p])) == text.format(short, long)


STORY = "This is the story, told at length. " * 20
TOLD = STORY.strip()


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><nav>N</nav><article class='post has-sidebar'><p>{0}</p></article></body>", "{0}"),
        ("<body><article class='entry share-enabled'><p>{0}</p></article></body>", "{0}"),
        ("<body><article class='hentry comment-open'><p>{0}</p></article></body>", "{0}"),
        ("<div class='page with-nav'><div><p>{0}</p></div></div>", "{0}"),
        ("<article><p>{0}</p><section id='share-price'><p>At noon. {0}</p></section></article>", "{0}\nAt noon. {0}"),
        ("<div class='modal'><p>{0}</p></div>", "{0}"),
        ("<body><div class='cookie-notice'><p>We use cookies.</p></div><div class=x><p>{0}</p></div></body>", "{0}"),
        ("<article><p>{0}</p><div class='share-links'><a href=x>one</a> <a href=x>two</a></div></article>", "{0}"),
        ("<article><p>{0}</p><div class=comments><article class=comment><p>{0}{0}{0}</p></article></div></article>", "{0}"),
        ("<body><p>Site</p><div id=c><h1>T</h1><p class=lead>L</p><div class=body><p>{0}</p></div></div></body>", "T\nL\n{0}"),
        ("<article><p>{0} one<script>x='</p>'</script> two <button>b</button>three<img src=x> four</p></article>", "{0} one two three four"),
        ("<article><p>{0}<select><option>o<option>q</select> end</p><svg><p>no</p></svg></article>", "{0} end"),
        ("<article><p>{0}</p><button>never closed<p>gone</article><p>after</p>", "{0}"),
    ],
)
def test_articles_are_kept_whole(html, text):
    assert html_consensus.main_text(html.format(TOLD), []) == text.format(TOLD)


def test_very_deep_pages_take_memory_by_their_length():
    def peak(depth: int) -> int:
        tracemalloc.start()
        try:
            assert html_consensus.main_text("<div>" * depth + "<p>deep</p>" + "x</div>" * depth, []) == "deep\nx"
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(40_000) < 6 * peak(10_000) < 6 * 30_000_000


def test_pages_of_a_host_with_many_templates(spark):
    pages = []
    for t in range(40):
        for i in range(3 if t else 40):
            body, talk = (20, 90) if i == 2 else (90, 20)  # on every third page the talk outweighs the story
            html = f"<div class=t{chr(97 + t % 26)}{'x' * (t // 26)}><div class=story><p>{'s' * body}</p></div><div class=talk><p>{'t' * talk}</p></div></div>"
            pages.append((len(pages), "http://h.org/1", html))
    table = spark.createDataFrame([*pages, pages[5]], "page_id long, url string, html string").repartition(3)
    rows = html_consensus.extract_text(table).collect()
    assert len(rows) == len(pages) + 1 and all(set(row.text) == {"s"} for row in rows)


def plain_repeats(docs, length):
    texts = [(text or "").encode() for _, text in docs]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    result = []
    for (doc, _), t in zip(docs, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        result.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=repr)


@pytest.mark.parametrize("stretches_per_shard", [suffix_dedup.SHARD_STRETCHES, 4])
def test_repeats_equal_a_plain_count(spark, monkeypatch, stretches_per_shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_STRETCHES", stretches_per_shard)
    rng, length = random.Random(3), 60
    passage = words(rng, 40)
    docs = [(row[0], row[1]) for row in odd_texts() if len(row[1] or "") < 10_000]
    docs += [(50, passage), (51, passage), (52, "x" + passage[:80] + "yé" + passage[30:]), (53, "ab" * 300), (54, "y" * 60), (55, "z" * 61)]
    docs += [(100 + i, words(rng, 20) + passage[: rng.randint(55, 120)] + words(rng, 20)) for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    left = suffix_dedup.remove_repeats(table, length=length).collect()
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in left]
    assert sorted(got, key=repr) == plain_repeats(docs, length)


def test_repeats_in_odd_tables(spark):
    left = suffix_dedup.remove_repeats(odd_documents(spark), as_text=True).collect()
    assert len(left) == len(odd_texts()) and all(isinstance(row.kept, str) for row in left)
    assert {len(row.kept) for row in left if row.n_bytes > 100_000} == {0}
    assert suffix_dedup.remove_repeats(empty_documents(spark)).count() == 0


def test_search_of_word_passages_reads_written_codes(spark, monkeypatch):
    plans, search = [], suffix_dedup.repeated_spans

    def watched(docs, *args):
        plans.append(docs._jdf.queryExecution().toString())
        return search(docs, *args)

    monkeypatch.setattr(suffix_dedup, "repeated_spans", watched)
    monkeypatch.setattr(suffix_dedup, "_STEP_CODED", 256)  # texts in many steps
    passage = " ".join(f"word{i}" for i in range(8))
    texts = [f"one {passage} x", f"other\n{passage}", None, "", "none of these", "long " * 200, f"{passage} {passage}"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r.key: sorted(map(tuple, r.word_spans)) for r in suffix_dedup.repeated_word_spans(table, "text", 8).collect()}
    keys = {r.text: r.key for r in table.select("text", suffix_dedup.text_key(F.col("text")).alias("key")).collect()}
    spans = {t: sorted({w for a, b in found[k] for w in range(a, b + 1)}) for t, k in keys.items() if k in found}
    assert spans == {texts[0]: [1], texts[1]: [1], texts[5]: list(range(193)), texts[6]: [0, 8]}
    assert len(plans) == 1 and "InArrow" not in plans[0]  # two Python steps of a task have two workers


def plain_word_repeats(texts, n):
    split = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", t.encode())] for t in texts]
    counts = Counter(tuple(w[2] for w in one[i : i + n]) for one in split for i in range(len(one) - n + 1))
    left = []
    for t, one in zip(texts, split):
        gone = np.zeros(len(t.encode()), bool)
        for i in range(len(one) - n + 1):
            if counts[tuple(w[2] for w in one[i : i + n])] > 1:
                gone[one[i][0] : one[i + n - 1][1]] = True
        left.append(bytes(b for b, g in zip(t.encode(), gone) if not g).decode())
    return left


def test_pipeline_cuts_short_words(spark):
    rng = random.Random(5)
    passage = words(rng, 51).split()
    texts = [words(rng, 70) + "\n" + " ".join(passage) + "\n" + words(rng, 90), words(rng, 60) + " " + "  ".join(passage) + " é " + words(rng, 40)]
    texts += [words(rng, 30) + " " + " ".join(passage[:-1]) + " " + words(rng, 40) for _ in range(2)]  # 50 words stay
    texts += [words(rng, 9) + " " + " ".join(passage[3:] + ["z"] * 3) for _ in range(2)] + ["z " * 55 + "end", "", words(rng, 80)]
    assert len(" ".join(passage)) < 400
    table = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(3)
    rows = sorted(corpus_pipeline.repeats(spark, table, "").collect())
    assert [row.text for row in rows] == plain_word_repeats(texts, 51)
    assert rows[0].text != texts[0] and rows[2].text == texts[2] and all(row.n_chars == len(row.text) for row in rows)
    # strings of 400 bytes with few words go as before
    long = "".join(rng.choice("abc") for _ in range(500))
    table = spark.createDataFrame([(i, f"{i} {long}", 1) for i in range(2)], "doc_id long, text string, n_chars long")
    assert all(len(row.text) < 4 for row in corpus_pipeline.repeats(spark, table, "").collect())


def test_prefixes_and_frequent_shingles_take_little_memory():
    rng = np.random.default_rng(0)
    kind = pa.list_(pa.struct([("df", pa.int64()), ("token", pa.int64()), ("place", pa.int32())]))
    all_ = [[{"df": int(rng.integers(2, 99)), "token": i * 40 + j, "place": j} for j in range(40)] for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([300] * 5000), pa.array(all_, kind)], names=["class", "n", "all"])
    sets = [np.unique(rng.integers(0, 1 << 40, 500).astype(np.uint64)) for _ in range(2000)]
    sets[::7] = [sets[0]] * len(sets[::7])
    found, counts = np.unique(np.concatenate(sets), return_counts=True)
    tracemalloc.start()
    try:
        rows = 0
        for part in ngram_join.prefix_rows(batch, 85):
            rows += part.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        often = ngram_join.found_often(sets)
        again = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 5000 * 40 and peak < 20e6 and again < 20e6
    assert [x.tolist() for x in often] == [found[counts > 2].tolist(), counts[counts > 2].tolist()] and not sets


def test_shards_sort_as_far_as_windows_reach():
    rng = random.Random(5)
    for _ in range(300):
        length, symbols = rng.choice([1, 2, 5, 7, 8, 14, 15, 40]), rng.choice([1, 2, 200])
        base = bytes(rng.randrange(symbols) for _ in range(80))
        strings = [base[(a := rng.randrange(80)) : a + rng.randint(1, 60)] + bytes(rng.choices(base, k=rng.randint(0, 9))) for _ in range(6)]
        windows = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        plain = [[windows[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(strings, length)] == plain
    # most suffixes of long strings that share all but their ends
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(900)) * 40, np.uint8)
    ends = np.repeat(np.arange(900, 36001, 900), 900)
    order, changes = suffix_dedup.sorted_suffixes(data, ends, 400)
    assert changes.sum() == 900 and sorted(order.tolist()) == list(range(36000))


def test_fenwick_chains_equal_a_plain_search():
    rng = random.Random(6)
    for _ in range(30):
        points = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(25)]
        best = {}
        for x, y in sorted(set(points)):
            before = [s - chaining._GAP_COST * (x + y - a - b) + min(5, x - a, y - b) for (a, b), s in best.items() if a < x and b < y]
            best[x, y] = max([5.0, *before])
        top = chaining.chains(points, 5)
        assert sorted(p for chain in top for p in chain) == sorted(set(points))
        assert all(a < c and b < d for chain in top for (a, b), (c, d) in zip(chain, chain[1:]))


def test_planted_passages_are_found(spark):
    rng = random.Random(2)
    docs, planted, clean = [(row[0], row[1]) for row in odd_texts()], set(), set()
    for p in range(12):
        passage = words(rng, 70).split()
        for _ in range(3):
            changed = [words(rng, 1) if rng.random() < 0.02 else w for w in passage]
            docs.append((len(docs) + 100, words(rng, 60) + " " + " ".join(changed) + " " + words(rng, 90)))
            planted.add(docs[-1][0])
    for _ in range(60):
        docs.append((len(docs) + 100, words(rng, 120)))
        clean.add(docs[-1][0])
    rows = chaining.shared_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    found = {d for row in rows for d in (row.doc_id, row.other_id)}
    assert planted <= found and not clean & found
    assert (8, 7) in {(row.doc_id, row.other_id) for row in rows}  # the two long copies
    assert chaining.shared_passages(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("rare", [chaining.RARE, 4])
def test_passages_whose_parts_stand_elsewhere(spark, rare):
    rng = random.Random(1)  # all common seeds of 10 and 20 stand in 1-4 and in 91-94 too
    passage = words(rng, 60).split()
    docs = [(i, words(rng, 50) + " " + " ".join(passage) + " " + words(rng, 50)) for i in (10, 20)]
    for i, start in enumerate((0, 14, 28, 42)):  # parts of 18 words, in smaller and in larger ids
        docs += [(first + i, words(rng, 40) + " " + " ".join(passage[start : start + 18]) + " " + words(rng, 40)) for first in (1, 91)]
    rows = chaining.shared_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), rare=rare).collect()
    assert [(r.doc_id, r.other_id) for r in rows] == [(20, 10)] and rows[0].n_equal >= 60


def test_passages_whose_parts_stand_in_many_documents(spark):
    rng = random.Random(3)  # two documents share 36 words; any two seeds of these stand in six others
    passage = words(rng, 36).split()
    docs = [(i, words(rng, 50) + " " + " ".join(passage) + " " + words(rng, 50)) for i in (1000, 1001)]
    for i in range(8):
        for j in range(i, 8):
            for copy in range(6):
                kept = [w if n // 4 in (i, i + 1, j, j + 1) else words(rng, 1) for n, w in enumerate(passage)]
                docs.append((len(docs) + 2000 * (copy % 2), words(rng, 20) + " " + " ".join(kept) + " " + words(rng, 20)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for rare in (chaining.RARE, 4):
        rows = chaining.shared_passages(table, rare=rare).collect()
        assert [(r.doc_id, r.other_id) for r in rows] == [(1001, 1000)] and rows[0].n_equal >= 36


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_equal_a_comparison_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    few = ["a", "of", "the", "in", "bb", "cc", "dd"]
    draw = lambda n: [rng.choice(few) if rng.random() < 0.3 else words(rng, 1) for _ in range(n)]
    lines, texts = [draw(rng.choice([6, 12, 20, 40])) for _ in range(6)], []
    for _ in range(60):
        text = draw(rng.randint(0, 60))
        for _ in range(rng.randint(0, 4)):
            for word in rng.choice(lines):
                text += [] if rng.random() < 0.04 else draw(1) if rng.random() < 0.06 else [word]
            text += draw(rng.choice([0, 2, 30, 80]))
        texts.append(text + ["of", "the"] * rng.choice([0, 0, 3, 20]))
    expected = set()
    for a in range(len(texts)):
        for b in range(a):
            seeds = {}
            for y in range(len(texts[b]) - 3):
                seeds.setdefault(tuple(texts[b][y : y + 4]), []).append(y)
            points = [(x, y) for x in range(len(texts[a]) - 3) for y in seeds.get(tuple(texts[a][x : x + 4]), [])]
            words_ = [[w.encode() for w in texts[i]] for i in (a, b)]
            for chain in chaining.chains(points, 4):
                for x1, x2, y1, y2, same in chaining.align_chain(*words_, chain, 4) if len(chain) > 1 else []:
                    if min(x2 - x1, y2 - y1) >= 30 and same >= 0.8 * max(x2 - x1, y2 - y1):
                        expected.add((a, b, x1, x2, y1, y2, same))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for rare in (chaining.RARE, 5):
        assert {tuple(row) for row in chaining.shared_passages(table, rare=rare).collect()} == expected
    assert len(expected) > 20


def test_a_string_of_many_documents_takes_little_disk(spark):
    rng = random.Random(8)  # 245,000 pairs of documents share six words, two of the documents 34
    passage = words(rng, 34)
    docs = [(i, " ".join([words(rng, 10), "all of them have these words", words(rng, 10), passage if i in (5, 600) else ""])) for i in range(700)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    sizes, over = {}, threading.Event()

    def look():  # files of an exchange go when they are not needed any more
        while not over.wait(0.02):
            for name in (os.path.join(d, n) for top in folders for d, _, names in os.walk(top) for n in names):
                with contextlib.suppress(OSError):
                    sizes[name] = max(sizes.get(name, 0), os.path.getsize(name))
            if not known:
                known.append(dict(sizes))

    known: list[dict[str, int]] = []
    watcher = threading.Thread(target=look)
    watcher.start()
    while not known:
        time.sleep(0.02)
    rows = chaining.shared_passages(table).collect()
    over.set()
    watcher.join()
    written = sum(size for name, size in sizes.items() if name not in known[0])
    assert [(r.doc_id, r.other_id, r.n_equal >= 34) for r in rows] == [(600, 5, True)]
    assert written < 1_500_000


@pytest.mark.parametrize("few", [True, False])
def test_passages_of_many_blocks(spark, monkeypatch, few):
    rng = random.Random(9)
    lines, docs = [words(rng, 45) for _ in range(4)], []
    for i in range(90):
        parts = [words(rng, rng.randint(0, 30)), *(rng.choice(lines) for _ in range(rng.randint(0, 2))), "of the " * rng.choice([0, 9, 40])]
        docs.append((f"d{rng.randint(0, 70)}", " ".join(parts)))  # some ids have two texts
    docs += docs[:6] + [("copy", text) for _, text in docs[:4]] + [("z", None), ("z", ""), (None, docs[0][1])]
    schema = "doc_id string, text string"
    whole = sorted(tuple(r) for r in chaining.shared_passages(spark.createDataFrame(docs, schema).repartition(3)).collect())
    monkeypatch.setattr(chaining, "_BLOCK_TEXT", 20_000 if few else 6_000)
    monkeypatch.setattr(chaining, "_LEAST_RIGHT", 24 if few else 3)
    parts = chaining.shared_passages(spark.createDataFrame(docs[::-1], schema).repartition(5), rare=3)
    assert sorted(tuple(r) for r in parts.collect()) == whole and len(whole) > 100


def test_ends_of_passages_go_on_past_a_margin(spark):
    rng = random.Random(11)  # 32 equal words, then three of four equal 30 times over
    first = words(rng, 400).split()
    second = [w if i < 132 and i >= 100 or 132 < i < 252 and i % 4 else "other" for i, w in enumerate(first)]
    table = spark.createDataFrame([(1, " ".join(first)), (2, " ".join(second))], "doc_id long, text string")
    (row,) = chaining.shared_passages(table, share=0.76).collect()
    points = [(i, i) for i in range(100, 129)]
    (expected,) = chaining.align_chain(second, first, points, 4, 0.76)
    assert tuple(row)[2:] == expected and row.stop - row.start > 150


@pytest.mark.parametrize("n, share", [(30, 0.8), (30, 0.85), (30, 0.9), (60, 0.8)])
@pytest.mark.parametrize("even", [False, True])
def test_recall_of_changed_passages(spark, n, share, even):
    rng, found, trials = random.Random(n), 0, 40
    for _ in range(trials):
        own = lambda size: ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(size)]
        first = own(n)
        second, changes = list(first), int(n * (1 - share) + 1e-9)
        for i in [int((i + 0.5) * n / changes) for i in range(changes)] if even else rng.sample(range(1, n - 1), changes):
            second[i] = own(1)[0]
        texts = [" ".join(own(60) + one + own(50)).encode() for one in (first, second)]
        data, places = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        settings = inspect.signature(chaining.shared_passages).parameters
        k, window = settings["k"].default, settings["window"].default
        (one, at), (other, there) = chaining._seeds(data, places, k, window)
        points = [(int(x), int(y)) for h, x in zip(one, at) for g, y in zip(other, there) if h == g]
        passages = [p for c in chaining.chains(points, k) if len(c) > 1 for p in chaining.align_chain(*(t.split() for t in texts), c, k)]
        found += any(min(x2 - x1, y2 - y1) >= n and same >= share * max(x2 - x1, y2 - y1) for x1, x2, y1, y2, same in passages)
    assert found >= 0.95 * trials


def test_token_totals(spark, folder):
    totals = token_counts.TokenTotals(spark, folder)
    schema = "source string, lang string, version string, tokens long, other int"
    first = spark.createDataFrame([("a", "en", "1", 5, 0), ("a", "en", "1", 7, 0), (None, None, "1", None, 0)], schema)
    assert totals.totals().count() == 0
    assert totals.apply("b1", token_counts.inserts(first)) and not totals.apply("b1", token_counts.inserts(first))
    new = first.limit(0).unionAll(spark.createDataFrame([("b", "en", "2", 9, 0)], schema))
    assert totals.apply("b2", token_counts.revisions(first.where("tokens = 5"), new))
    assert totals.apply("b3", token_counts.deletes(first.where("source IS NULL")))
    assert totals.apply("b4", token_counts.inserts(first.limit(0)))
    # a commit that was cut short: its totals are there, its ids are not
    totals.totals().write.parquet(f"{folder}/commit={4:012d}/totals")
    assert {tuple(r) for r in totals.totals().collect()} == {("a", "en", "1", 1, 7), ("b", "en", "2", 1, 9)}
    assert totals.apply("b5", token_counts.deletes(new)) and totals.totals().count() == 1
    with pytest.raises(ValueError):
        totals.apply(None, token_counts.inserts(first))


def test_two_writers_of_token_totals(spark, folder, monkeypatch):
    schema = "source string, lang string, version string, tokens long"
    one = token_counts.inserts(spark.createDataFrame([("a", "en", "1", 5)], schema))
    two = token_counts.inserts(spark.createDataFrame([("a", "en", "1", 7)], schema))
    first, second = (token_counts.TokenTotals(spark, folder) for _ in range(2))
    take, late = token_counts.TokenTotals._take, []

    def other_first(self, attempt, number):
        if self is first and not late:
            late.append(second.apply("b2", two))  # both saw the same state
        return take(self, attempt, number)

    monkeypatch.setattr(token_counts.TokenTotals, "_take", other_first)
    assert first.apply("b1", one) and late == [True]
    assert [tuple(r) for r in first.totals().collect()] == [("a", "en", "1", 2, 12)]
    assert not first.apply("b2", two) and not second.apply("b1", one)
    assert not list(pathlib.Path(folder).glob("attempt-*"))


def test_ids_of_many_batches(spark, folder, monkeypatch):
    monkeypatch.setattr(token_counts, "TOGETHER", 3)
    totals = token_counts.TokenTotals(spark, folder)
    row = spark.createDataFrame([("a", "en", "1", 1)], "source string, lang string, version string, tokens long")
    for i in range(8):
        assert totals.apply(f"b{i}", token_counts.inserts(row))
    assert not any(totals.apply(f"b{i}", token_counts.inserts(row)) for i in range(8))
    assert totals.totals().first().n_tokens == 8


def test_token_totals_equal_sql(spark, small):
    ours = queries.op9_token_counts(spark, small).toPandas()
    theirs = duckdb_over(small).execute(queries.ORACLE_SQL["op9_token_counts"]).df()
    assert normalized(ours) == normalized(theirs)


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(3, None), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {row.node: row.component for row in found} == {x: root(x) for x in parent}


def test_pipeline_stages(spark, small):
    docs = queries.table(spark, small, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    seen = [row.asDict() for row in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, small)
        if name != "tokens":
            assert after.columns == docs.columns
        rows = after.collect()
        ids = {row["doc_id"] for row in seen}
        assert {row.doc_id for row in rows} <= ids and len(rows) == len({row.doc_id for row in rows})
        if name == "quality":
            bad = {r.doc_id for r in queries.op8_line_crf(spark, small).where("predicted = 0").collect()}
            assert {row.doc_id for row in rows} == ids - bad
        if name == "repeats":
            plain = {r[0]: r for r in plain_repeats([(row["doc_id"], row["text"]) for row in seen], 400)}
            assert all(len(row.text.encode()) <= plain[row.doc_id][1] - plain[row.doc_id][2] for row in rows)
        if name == "benchmark":
            hit = decontaminate.find_items(docs, queries.table(spark, small, "benchmark")).where("size(hits) > 0")
            assert {row.doc_id for row in rows} == ids - {r.doc_id for r in hit.collect()}
        if name == "tokens":
            assert len(rows) == len(seen) and all(row.round_trip for row in rows)
        docs = spark.createDataFrame(rows, after.schema)
        seen = [row.asDict() for row in rows]


def test_repeated_rows_are_neighbours_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0]), (5, [2.0, 1.0]), (6, [1.0, 0.0]), (20, [1.0, 0.0])]
    rows += [(7, [0.5, 0.0])] * 30
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann_forest.nearest(table, F.col("vec_id") == 20).collect()
    wanted = [(5, 2.0)] * 3 + [(6, 1.0)] + [(7, 0.5)] * 16
    ranked = [(i, *pair) for i, pair in enumerate(wanted, 1) for _ in range(2)]  # the query's row is there twice
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == ranked
