"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_rows, stored, workspace
from . import (
    ann_forest, bpe, chaining, decontaminate, html_consensus, line_crf, ngram_join, packing, ranked_search, suffix_dedup,
    token_counts, url_filter, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> bpe.Vocabulary:
    return bpe.Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector id among all other rows."""
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as counts and digests."""
    words = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_texts(docs, words, drop=True, decode=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages that documents share; copies of a text are linked to its smallest id."""
    return chaining.shared_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links by four-word shingles and a similarity of 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.link_documents(docs).select("doc_id", "n_shingles", "component_id")


URL_RULES = [
    url_filter.Rule("org", "/", True),
    url_filter.Rule("example.org", "/es/", False),
    url_filter.Rule("example.org", "/en/1", False),
    url_filter.Rule("com", "/fr/", True),
    url_filter.Rule("com", "/de/", False),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, or else by its n-grams."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = local_rows(spark, url_filter.labelled_urls(), "url string, label int")
    judged = url_filter.judge_urls(pages, URL_RULES, url_filter.fit_labelled(labelled))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_consensus.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings that occur twice, as counts and a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = suffix_dedup.remove_repeats(docs, drop=True)
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, by a model of labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score_quality(docs, model, keep_lines=False)
    return scored.select(
        "doc_id",
        line_crf.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after loading all documents, counting them by a second version, and two corrections.

    Version ``words`` counts runs of other than white space, ``letters`` runs of ASCII letters. Toxic
    documents are then deleted; documents of low quality get distinct words for their count. The first
    and the third batch are sent twice. Texts are counted where they are read; only counts are joined.
    """
    labels = table(spark, sf_dir, "labels")
    totals = token_counts.TokenTotals(spark, workspace(spark, "token-counts"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    letters = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", words.alias("words"), F.size(letters).alias("letters"))
    distinct = F.size(F.array_distinct("words")).alias("distinct")
    docs = stored(docs.select("doc_id", "source", "lang", F.size("words").alias("words"), distinct, "letters"), "counts")

    def counted(rows: DataFrame, version: str, count: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("version"), F.col(count).alias("tokens"))

    toxic = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    low = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    low = low.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    first = token_counts.inserts(counted(docs, "words", "words"))
    gone = token_counts.deletes(counted(toxic, "words", "words"))
    totals.apply("load", first)
    totals.apply("letters", token_counts.inserts(counted(docs, "letters", "letters")))
    totals.apply("toxic", gone)
    totals.apply("load", first)
    totals.apply("revised", token_counts.revisions(counted(low, "words", "words"), counted(low, "words", "distinct")))
    totals.apply("toxic", gone)
    return totals.totals()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie in windows of benchmark items, and these items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the principal components of the distinct ones, in units of their deviation."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whitened_rows(rows, whitening.fit_whitening(rows))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.search(docs, table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in pieces, and the sequence and place of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)


QUERIES: dict[str, Query] = {
    "op1_ann_forest": op1_ann_forest,
    "op2_bpe": op2_bpe,
    "op3_chaining": op3_chaining,
    "op4_ngram_join": op4_ngram_join,
    "op5_url_filter": op5_url_filter,
    "op6_html_consensus": op6_html_consensus,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_line_crf": op8_line_crf,
    "op9_token_counts": op9_token_counts,
    "op10_decontaminate": op10_decontaminate,
    "op11_whitening": op11_whitening,
    "op12_ranked_search": op12_ranked_search,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op9_token_counts": r"""
WITH d AS (
  SELECT doc_id, source, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    len(regexp_extract_all(text, '[A-Za-z]+')) AS n_letters,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS low
  FROM documents)
SELECT source, lang, 'words' AS version, count(*) AS n_docs,
  CAST(sum(CASE WHEN low THEN len(list_distinct(w)) ELSE len(w) END) AS BIGINT) AS n_tokens
FROM d WHERE NOT toxic GROUP BY ALL
UNION ALL
SELECT source, lang, 'letters' AS version, count(*) AS n_docs, CAST(sum(n_letters) AS BIGINT) AS n_tokens
FROM d GROUP BY ALL""",
    "op12_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d WHERE len(words) > 0),
p AS (
  SELECT r, doc_id, len(words) AS n, term, count(*) AS tf
  FROM (SELECT r, doc_id, words, unnest(words) AS term FROM d) GROUP BY ALL),
i AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))
  GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM p, s WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs),
x AS (
  SELECT item_id, r, doc_id,
    CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
WHERE rank <= 20""",
}
