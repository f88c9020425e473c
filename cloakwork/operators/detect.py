"""Which columns hold PII, for a whole catalog at once.

Three tiers per dataset: an explicit scope; else fields with a PII tag; else column names that
contain a rule's pattern, unless sampled values speak against it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NAME_PATTERNS, VALIDATORS
from ..functions.names import has_pii_tag, leaf_column, quoted
from ..functions.patterns import matches, spark_pattern
from ..session import local_rows

TIERS = ("explicit", "tag", "heuristic")


@dataclass(frozen=True)
class Rules:
    """Name patterns, and for some of them a regular expression for the values.

    Rules are configuration, not data: they become literals of the plan, so regular expressions are
    compiled once and matching a name needs no join.
    """

    patterns: tuple[str, ...] = NAME_PATTERNS
    validators: dict[str, str] = field(default_factory=lambda: dict(VALIDATORS))

    def __post_init__(self) -> None:
        for pattern in self.validators.values():
            spark_pattern(pattern)  # raises here, not in a job, if it cannot be expressed

    @classmethod
    def from_dict(cls, config: dict) -> Rules:
        """Missing or empty entries fall back to the defaults."""
        return cls(
            tuple(config.get("name_patterns") or NAME_PATTERNS),
            dict(config.get("regex_validators") or VALIDATORS),
        )

    @classmethod
    def from_table(cls, table: DataFrame) -> Rules:
        """From a configuration table ``pattern, validator``."""
        rows = list(table.select("pattern", "validator").toLocalIterator())
        return cls.from_dict(
            {
                "name_patterns": [r.pattern for r in rows],
                "regex_validators": {r.pattern: r.validator for r in rows if r.validator},
            }
        )

    def describe(self) -> dict[str, list[str]]:
        return {
            "name_patterns": list(self.patterns),
            "regex_validators": list(self.validators),
        }

    def pairs(self) -> list[tuple[str, str | None]]:
        """Lower-cased patterns, each with its validator or None."""
        return [(p.lower(), self.validators.get(p.lower())) for p in self.patterns]

    def table(self, spark: SparkSession) -> DataFrame:
        return local_rows(spark, self.pairs(), "pattern string, validator string")


def _hit(validator: str) -> str:
    return f"hit_{validator}"


def sample_text(df: DataFrame, name: str) -> Column:
    """A sampled value as text. Booleans print as ``True`` and ``False``."""
    text = F.col(quoted(name)).cast("string")
    return F.initcap(text) if isinstance(df.schema[name].dataType, T.BooleanType) else text


def _profile_columns(text: Column, rules: Rules) -> list[Column]:
    hits = [
        F.coalesce(F.bool_or(matches(text, regex)), F.lit(False)).alias(_hit(name))
        for name, regex in rules.validators.items()
    ]
    return [F.count(F.lit(1)).alias("n"), *hits]


def profile_schema(rules: Rules) -> str:
    """Columns of a profile, without what it is a profile of."""
    hits = "".join(f", `{_hit(name)}` boolean" for name in rules.validators)
    return f"column_name string, n bigint{hits}"


def profile_samples(
    samples: DataFrame, rules: Rules | None = None, *, keys: list[str], value: str = "val"
) -> DataFrame:
    """One row per sampled column: ``n`` values, NULLs included, and per validator any match.

    One pass whose partial aggregates are a count and a few booleans, however unevenly the values
    spread over columns.
    """
    rules = rules or Rules()
    return samples.groupBy(*keys).agg(*_profile_columns(sample_text(samples, value), rules))


def profile_table(
    df: DataFrame, columns: list[str] | None = None, rules: Rules | None = None
) -> DataFrame:
    """Profile of columns of a table, by default its string columns: ``column_name, n, hit_*``.

    One scan that reads only these columns.
    """
    rules = rules or Rules()
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    wide = df.agg(
        *[F.struct(*_profile_columns(sample_text(df, c), rules)).alias(c) for c in columns]
    )
    long = wide.unpivot([], [quoted(c) for c in columns], "column_name", "profile")
    return long.select("column_name", "profile.*")


def profile_rows(profile: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Profile with one row per column and validator: ``..., validator, n, any_match``."""
    rules = rules or Rules()
    hits = [_hit(v) for v in rules.validators]
    keys = [c for c in profile.columns if c not in hits]
    long = profile.unpivot(keys, hits, "validator", "any_match")
    name = F.expr(f"substring(validator, {len(_hit('')) + 1})")
    return long.withColumn("validator", name)


def _named_like_pii(name: Column, rules: Rules, sampled: bool) -> Column:
    """The name contains a pattern whose validator, if any, passes on the samples.

    Patterns that need no look at samples are tested by one regular expression, so the name is
    worked out once and not once per pattern.
    """
    lowered = F.lower(name)
    checked = {p for p, validator in rules.pairs() if sampled and validator}
    free = [re.escape(p) for p, _ in rules.pairs() if p not in checked]
    tests = [lowered.rlike("|".join(free))] if free else []
    for pattern in sorted(checked):
        # No sample at all says nothing; NULLs alone are samples that do not match.
        passes = F.col("n").isNull() | (F.col("n") == 0) | F.col(quoted(_hit(pattern)))
        tests.append(F.contains(lowered, F.lit(pattern)) & passes)
    return reduce(or_, tests)


def heuristic_columns(
    fields: DataFrame,
    rules: Rules | None = None,
    profile: DataFrame | None = None,
    *,
    key: str = "urn",
    profile_keys: list[str] | None = None,
) -> DataFrame:
    """Columns found by name: ``key, column_name``, distinct.

    ``profile`` comes from :func:`profile_samples` and is looked up by ``profile_keys``, by default
    dataset and column.
    """
    rules = rules or Rules()
    named = fields.select(key, leaf_column(F.col("field_path")).alias("column_name"))
    named = named.where(_named_like_pii(F.col("column_name"), rules, sampled=False)).distinct()
    if profile is None:
        return named
    keys = profile_keys or [key, "column_name"]
    hits = [quoted(_hit(v)) for v in rules.validators]
    joined = named.join(profile.select(*keys, "n", *hits), keys, "left")
    return joined.where(_named_like_pii(F.col("column_name"), rules, sampled=True)).select(
        key, "column_name"
    )


def tagged_columns(fields: DataFrame, *, key: str = "urn", boundary: bool = False) -> DataFrame:
    """Columns of fields with a PII tag: ``key, column_name``, distinct."""
    return (
        fields.where(has_pii_tag(F.col("tags"), boundary=boundary))
        .select(key, leaf_column(F.col("field_path")).alias("column_name"))
        .distinct()
    )


def explicit_columns(fields: DataFrame, scope: DataFrame, *, key: str = "urn") -> DataFrame:
    """Columns asked for by name: ``key, column_name``, distinct.

    ``scope`` has ``key, name``; a name is a field path or a column, unknown names are dropped.
    """
    column_name = leaf_column(F.col("field_path"))
    names = F.explode(F.array_distinct(F.array(F.col("field_path"), column_name)))
    known = fields.select(key, column_name.alias("column_name"), names.alias("name"))
    wanted = scope.select(key, "name").distinct()
    return known.join(wanted, [key, "name"], "left_semi").select(key, "column_name").distinct()


def detect(
    datasets: DataFrame,
    fields: DataFrame,
    *,
    scope: DataFrame | None = None,
    profile: DataFrame | None = None,
    rules: Rules | None = None,
    key: str = "urn",
    profile_keys: list[str] | None = None,
    boundary: bool = False,
) -> DataFrame:
    """Target columns of every dataset: ``key, tier, column_name``, one row per column.

    A dataset without any has one row with a NULL column. The tier of a dataset is ``explicit`` if
    its scope holds any name, known or not; else ``tag`` if any field has a PII tag; else
    ``heuristic``.
    """
    rules = rules or Rules()
    explicit, tag, heuristic = range(1, len(TIERS) + 1)
    # Without this the optimizer adds it to some uses of the scan only, which then share nothing.
    fields, datasets = fields.where(F.col(key).isNotNull()), datasets.where(F.col(key).isNotNull())

    # Every field is looked at once; those that no tier can name are gone before any shuffle.
    name = leaf_column(F.col("field_path"))
    ranks = F.array(
        F.when(has_pii_tag(F.col("tags"), boundary=boundary), tag),
        F.when(_named_like_pii(name, rules, sampled=False), heuristic),
    )
    found = fields.select(key, name.alias("column_name"), F.explode(ranks).alias("rank"))
    found = found.where("rank IS NOT NULL").distinct()
    if profile is not None:
        keys = profile_keys or [key, "column_name"]
        hits = [quoted(_hit(v)) for v in rules.validators]
        passes = _named_like_pii(F.col("column_name"), rules, sampled=True)
        found = found.join(profile.select(*keys, "n", *hits), keys, "left")
        found = found.where((F.col("rank") != heuristic) | passes)
    found = found.select(key, "column_name", "rank")
    opened = datasets.select(key, F.lit(heuristic).alias("rank"))
    if scope is not None:
        scope = scope.where(F.col("name").isNotNull() & F.col(key).isNotNull())
        named = explicit_columns(fields, scope, key=key)
        found = found.unionByName(named.withColumn("rank", F.lit(explicit)))
        opened = opened.unionByName(scope.select(key, F.lit(explicit).alias("rank")))

    # A mark is twice the tier's rank, plus one if it stands for no column. The smallest mark of a
    # dataset gives its tier and whether that tier found anything; being a number it is a hash
    # aggregate, which shrinks every dataset to one row before the shuffle.
    marks = opened.select(key, (F.col("rank") * 2 + 1).alias("mark")).unionByName(
        found.select(key, (F.col("rank") * 2).alias("mark"))
    )
    first = marks.groupBy(key).agg(F.min("mark").alias("mark"))
    tiers = first.select(
        key, F.shiftright("mark", 1).alias("rank"), (F.col("mark") % 2 == 0).alias("has_columns")
    )
    # Inner join, so that a dataset with a large share of all columns can be split at run time;
    # datasets without columns are added instead of kept by an outer join.
    none = tiers.where("NOT has_columns").select(
        key, "rank", F.lit(None).cast("string").alias("column_name")
    )
    some = found.join(tiers.where("has_columns"), [key, "rank"]).select(key, "rank", "column_name")
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("rank"))
    return some.unionByName(none).select(key, tier.alias("tier"), "column_name")


def rule_usage(fields: DataFrame, rules: Rules | None = None, *, key: str = "urn") -> DataFrame:
    """The rules in force and how many columns each one's name pattern meets in the catalog."""
    rules = rules or Rules()
    columns = fields.select(key, F.lower(leaf_column(F.col("field_path"))).alias("name"))
    counts = columns.agg(
        *[
            F.struct(
                F.lit(pattern).alias("pattern"),
                F.lit(validator).cast("string").alias("validator"),
                F.count_if(F.contains("name", F.lit(pattern))).alias("fields"),
            ).alias(f"r{i}")
            for i, (pattern, validator) in enumerate(rules.pairs())
        ]
    )
    return counts.select(F.inline(F.array(*counts.columns)))
