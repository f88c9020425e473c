"""From raw documents to token ids: five stages, each written and read again by the next one.

1. ``quality``: documents that the line model rejects go. It learns from ``labels``, but not from
   documents that are held out.
2. ``near_duplicates``: of documents linked by five-word shingles at 0.8, the smallest id stays.
3. ``repeats``: passages of 51 words, and strings of 400 bytes, that occur twice are cut out wherever
   they are; a document of which nothing is left stays, without words. ``n_chars`` follows the text.
4. ``benchmark``: documents that hold a window of a benchmark item go.
5. ``tokens``: byte-level BPE; the result has ids as little-endian 32-bit integers in one binary
   value, their number, and whether they decode to the text.

Rows are kept or dropped one by one, so NULLs, empty texts and repeated rows need nothing special:
an empty text has a score of its own, links with nothing and has no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import bpe, decontaminate, line_crf, ngram_join, suffix_dedup
from cloakwork.llm.queries import table, vocabulary
from cloakwork.session import stored


#: Words of a passage that is cut out where it repeats: more than 50.
PASSAGE_WORDS = 51
#: Bytes of text that a worker of the last stage encodes at once: memory counts there, after four stages.
TOKEN_STEP = 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = line_crf.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score_quality(docs, model, keep_lines=False)
    return scored.where("score >= 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(docs, as_text=True, drop=True, words=PASSAGE_WORDS)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return left.withColumns(new).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_texts(docs, vocabulary(), drop=True, check=True, step=TOKEN_STEP)
    return coded.select(
        "doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        "round_trip",
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: SQL expresses neither the model nor the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
