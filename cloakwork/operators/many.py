"""Name patterns by the thousand: a join by three letters instead of a condition for each pattern.

:class:`~cloakwork.operators.detect.Rules` become literals of the plan, which is right for a rule set a
person writes. A table of patterns, such as a glossary, is joined: a pattern stands under the three
letters of it that fewest names have, each name under all of its threes, and only pairs that share a
three are compared. Patterns of one or two letters stand under themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """All distinct substrings of a length; none if the text is shorter."""
    last = F.length(text) - size + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, size)))


def names_by_patterns(names: DataFrame, patterns: DataFrame, *, name: str = "name", pattern: str = "pattern") -> DataFrame:
    """``name, pattern``: which distinct names contain which distinct patterns, in any case of letters.

    NULLs match nothing and nothing matches them; an empty pattern is in every name.
    """
    wanted = patterns.select(F.lower(pattern).alias("pattern")).where("pattern IS NOT NULL").distinct()
    own = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    own = stored(own.withColumn("_lower", F.lower("name")), "names")
    size = F.least(F.length("pattern"), F.lit(GRAM))
    wanted = stored(wanted.withColumn("_size", size), "patterns")
    sizes = [row[0] for row in wanted.where("_size > 0").select("_size").distinct().collect()]  # at most three
    cut = [own.select("name", "_lower", F.explode(_grams(F.col("_lower"), F.lit(n))).alias("_gram")) for n in sizes]
    everywhere = not wanted.where("_size = 0").isEmpty()
    if not cut:
        found = own.select("name", F.lit("").alias("pattern")).limit(0)
    else:
        pieces = cut[0]
        for more in cut[1:]:
            pieces = pieces.unionByName(more)
        pieces = stored(pieces, "name-grams")
        common = pieces.groupBy("_gram").agg(F.count("*").alias("_names"))
        keys = wanted.where("_size > 0").select("pattern", F.explode(_grams(F.col("pattern"), F.col("_size"))).alias("_gram"))
        # a gram that no name has gives the pattern no place, and it needs none
        counted = keys.join(common, "_gram", "left")
        rarest = counted.groupBy("pattern").agg(
            F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("n"), "_gram")).alias("_key")
        )
        placed = rarest.where("_key.n > 0").select("pattern", F.col("_key._gram").alias("_gram"))
        found = pieces.join(placed, "_gram").where(F.contains("_lower", F.col("pattern"))).select("name", "pattern")
    if everywhere:
        found = found.unionByName(own.select("name", F.lit("").alias("pattern")))
    return found
