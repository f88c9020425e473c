"""Dataset URNs, field paths and tags as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    DATASET_URN_PATTERN,
    DEFAULT_DATABASE,
    PII_TAG_SUFFIXES,
    PLATFORM_URN_PREFIX,
    TAG_URN_PREFIX,
    THREE_PART_PLATFORM,
)
from .patterns import matches, spark_pattern


def quoted(name: str) -> str:
    """A column name for exact lookup, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def name_parts(name: Column) -> Column:
    return F.split(name, r"\.", -1)


def name_database(name: Column) -> Column:
    """Database of a dotted name; two-part names live in the default database."""
    parts = name_parts(name)
    return F.when(F.size(parts) == 2, F.lit(DEFAULT_DATABASE)).when(
        F.size(parts) > 2, F.get(parts, F.lit(0))
    )


def name_schema(name: Column) -> Column:
    parts = name_parts(name)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).when(
        F.size(parts) > 2, F.get(parts, F.lit(1))
    )


def name_table(name: Column) -> Column:
    """Table of a dotted name; of a name with more than three parts it is all the rest."""
    parts = name_parts(name)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).when(
        F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(3), F.size(parts)), ".")
    )


def urn_name(urn: Column) -> Column:
    return F.regexp_extract(urn, spark_pattern(DATASET_URN_PATTERN), 2)


def urn_problem(urn: Column) -> Column:
    """Why a URN cannot be used: ``pattern``, ``parts`` (name has one part), NULL if it can."""
    valid = F.coalesce(matches(urn, DATASET_URN_PATTERN), F.lit(False))
    return F.when(~valid, F.lit("pattern")).when(
        F.size(name_parts(urn_name(urn))) < 2, F.lit("parts")
    )


def dataset_ref(urn: Column) -> Column:
    """Struct of the parts of a valid URN."""
    pattern = spark_pattern(DATASET_URN_PATTERN)
    name = urn_name(urn)
    platform = F.substring_index(F.regexp_extract(urn, pattern, 1), ":", -1)
    return F.struct(
        platform.alias("platform"),
        name_database(name).alias("database"),
        name_schema(name).alias("schema_name"),
        name_table(name).alias("table_name"),
        F.regexp_extract(urn, pattern, 3).alias("env"),
    )


def table_expression(
    platform: Column, database: Column, schema_name: Column, table_name: Column
) -> Column:
    """Name of the table in its own system."""
    return F.when(
        platform == THREE_PART_PLATFORM,
        F.format_string("`%s`.`%s`.`%s`", database, schema_name, table_name),
    ).otherwise(F.concat_ws(".", schema_name, table_name))


def platform_urn(platform: Column) -> Column:
    return F.concat(F.lit(PLATFORM_URN_PREFIX), platform)


def dataset_urn(platform: Column, name: Column, env: Column) -> Column:
    return F.concat(
        F.lit("urn:li:dataset:("), platform_urn(platform), F.lit(","), name, F.lit(","), env,
        F.lit(")"),
    )


def leaf_column(field_path: Column) -> Column:
    """Column addressed by a field path: the text after the last dot."""
    return F.substring_index(field_path, ".", -1)


def has_pii_tag(tags: Column, *, boundary: bool = False) -> Column:
    """Any tag names PII.

    By default a tag counts when it *ends* in one of the names, so ``nonpii`` counts and
    ``pii.ssn`` does not. With ``boundary`` the whole tag name must be one of them.
    """

    def one(tag: Column) -> Column:
        if boundary:
            return tag.isin(*PII_TAG_SUFFIXES, *(TAG_URN_PREFIX + s for s in PII_TAG_SUFFIXES))
        return reduce(or_, [tag.endswith(suffix) for suffix in PII_TAG_SUFFIXES])

    return F.coalesce(F.exists(tags, one), F.lit(False))


def tag_urns(tags: Column) -> Column:
    """Distinct tag URNs, sorted, of an ``array<variant>`` of tag entries as a catalog returns them.

    An entry is ``{"tag": {"urn": ...}}`` or ``{"urn": ...}``; the second form counts only where
    ``tag`` is not an object. Other entries and empty URNs are dropped.
    """

    def urn(entry: Column) -> Column:
        nested = F.try_variant_get(entry, "$.tag", "map<string,variant>")
        return F.when(
            nested.isNotNull(), F.try_variant_get(entry, "$.tag.urn", "string")
        ).otherwise(F.try_variant_get(entry, "$.urn", "string"))

    found = F.filter(F.transform(tags, urn), lambda u: u.isNotNull() & (u != ""))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def add_and_remove(tags: Column, add: list[str], remove: list[str]) -> Column:
    """Tag set after removals, then additions; sorted."""
    empty = F.array().cast("array<string>")
    gone = F.array(*map(F.lit, remove)) if remove else empty
    new = F.array(*map(F.lit, add)) if add else empty
    return F.array_sort(F.array_union(F.array_except(F.coalesce(tags, empty), gone), new))


def csv(values: Column) -> Column:
    """Sorted, distinct, comma-joined text of an array; empty text for an empty array."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")
