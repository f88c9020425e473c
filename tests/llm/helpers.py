"""Tables with the awkward cases that every operator must take."""

import random


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def odd_texts() -> list[tuple]:
    """NULL, empty, blank, short, very long, repeated rows, NULL ids; with columns of clashing names."""
    rng = random.Random(4)
    long = words(rng, 30_000)
    texts = [None, "", "  \n\t", "one", "One  two", "é ñ 日本", "x" * 3000, long, long, "one", "ab\ncd\n\nab"]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(texts)]
    return [*rows, (3, "one", "s1"), (None, "one", None), (None, None, None)]


SCHEMA = "doc_id long, text string, "
CLASHES = (
    "ids", "Decoded", "score", "line_scores", "n_words", "items", "hits", "n_shingles", "component", "component_id", "kept",
    "n_bytes", "removed", "key", "_set", "host", "path",
)


def odd_documents(spark, clashing: bool = True):
    rows = odd_texts()
    if not clashing:
        return spark.createDataFrame(rows, SCHEMA + "source string").repartition(3)
    rows = [(*row, *[f"c{i}"] * len(CLASHES)) for i, row in enumerate(rows)]
    extra = ", ".join(f"`{name}` string" for name in CLASHES)
    return spark.createDataFrame(rows, SCHEMA + "source string, " + extra).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA + "source string")
