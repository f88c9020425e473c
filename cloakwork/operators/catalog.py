"""Operators on a metadata catalog held as two DataFrames.

``datasets`` has one row per dataset with ``global_tags array<string>``; ``fields`` has one row per
field with ``pos``, ``field_path`` and ``tags array<string>``. Both carry the dataset's urn. A
field list stays in rows and is never gathered per dataset, so a very wide dataset spreads over
tasks like any other rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RUN_TAG
from ..functions.names import csv, dataset_ref, leaf_column, tag_urns, urn_problem
from ..functions.patterns import matches

_NO_TAGS = "array<string>"


@dataclass(frozen=True)
class Catalog:
    datasets: DataFrame
    fields: DataFrame


def no_tags() -> Column:
    return F.array().cast(_NO_TAGS)


def split_urns(df: DataFrame, urn: str = "urn") -> tuple[DataFrame, DataFrame]:
    """Rows with a usable URN, with its parts as ``ref``; and the others, with ``reason``."""
    reason = urn_problem(F.col(urn))
    good = df.where(reason.isNull()).withColumn("ref", dataset_ref(F.col(urn)))
    bad = df.where(reason.isNotNull()).withColumn("reason", reason)
    return good, bad


def flatten_payloads(df: DataFrame, *, key: str = "urn", payload: str = "payload") -> Catalog:
    """Catalog from one JSON document per dataset. Datasets without a document are left out.

    Each document is parsed once per branch into a VARIANT, which keeps odd entries apart instead
    of losing their whole list. Before their fields are taken out, documents are dealt out anew: a task
    sorts all entries of the documents it was given, and a small file may make very many of them.
    """
    doc = F.try_parse_json(F.col(payload))
    parsed = df.select(F.col(key), doc.alias("doc"))
    properties = F.try_variant_get(
        "doc", "$.editableProperties.customProperties", "map<string,string>"
    )
    empty = no_tags()
    is_object = F.try_variant_get("doc", "$", "map<string,variant>").isNotNull()
    datasets = parsed.where(is_object).select(
        key,
        F.try_variant_get("doc", "$.name", "string").alias("name"),
        tag_urns(F.try_variant_get("doc", "$.globalTags.tags", "array<variant>")).alias(
            "global_tags"
        ),
        F.coalesce(properties, F.map_from_arrays(empty, empty)).alias("properties"),
    )
    dealt = df.select(key, payload).repartition(F.xxhash64(key, payload))
    parsed = dealt.select(key, doc.alias("doc"))
    base = parsed.select(
        key, F.posexplode(F.try_variant_get("doc", "$.schemaMetadata.fields", "array<variant>"))
    ).select(
        key,
        "pos",
        F.try_variant_get("col", "$.fieldPath", "string").alias("field_path"),
        F.try_variant_get("col", "$.nativeDataType", "string").alias("native_data_type"),
        _entry_tags("col"),
    )
    edits = parsed.select(
        key,
        F.posexplode(
            F.try_variant_get(
                "doc", "$.editableSchemaMetadata.editableSchemaFieldInfo", "array<variant>"
            )
        ),
    ).select(
        key,
        "pos",
        F.try_variant_get("col", "$.fieldPath", "string").alias("field_path"),
        _entry_tags("col"),
    )
    named = base.where(F.col("field_path") != "")
    return Catalog(datasets, effective_fields(named, edits, key=key))


def _entry_tags(entry: str) -> Column:
    tags = F.try_variant_get(entry, "$.globalTags.tags", "array<variant>")
    return tag_urns(tags).alias("tags")


def effective_fields(fields: DataFrame, edits: DataFrame, *, key: str = "urn") -> DataFrame:
    """Fields with the tags people added to them. Edits of unknown fields are ignored.

    Of several edits of one field the last (greatest ``pos``) counts. They are never broadcast: Spark
    takes their size from the files read, and what a document holds may be a hundred times that.
    """
    last = edits.groupBy(key, "field_path").agg(F.max_by("tags", "pos").alias("edited")).hint("merge")
    tags = F.array_union(
        F.coalesce("tags", no_tags()), F.coalesce("edited", no_tags())
    )
    return (
        fields.join(last, [key, "field_path"], "left")
        .withColumn("tags", F.array_sort(tags))
        .select(*fields.columns)
    )


def tag_lists(fields: DataFrame, *, key: str = "urn") -> DataFrame:
    return fields.select(key, "field_path", csv(F.col("tags")).alias("tags"))


def field_map(fields: DataFrame, *, key: str = "urn") -> DataFrame:
    """First field (lowest ``pos``) of each column."""
    return fields.groupBy(key, leaf_column(F.col("field_path")).alias("column_name")).agg(
        F.min_by("field_path", "pos").alias("field_path")
    )


def run_requests(datasets: DataFrame, fields: DataFrame, *, key: str = "urn") -> DataFrame:
    """What carries the run tag: ``key, field_path``, one row per tagged field.

    A tagged dataset gives one row with a NULL path, which stands for all of it.
    """
    whole = datasets.where(F.array_contains("global_tags", RUN_TAG)).select(
        key, F.lit(None).cast("string").alias("field_path")
    )
    parts = fields.where(F.array_contains("tags", RUN_TAG)).select(key, "field_path").distinct()
    return whole.unionByName(parts.join(whole.select(key), key, "left_anti"))


def tagged_field_counts(fields: DataFrame, *, key: str = "urn") -> DataFrame:
    """Number of fields with the run tag, for datasets that have any."""
    return (
        fields.where(F.array_contains("tags", RUN_TAG))
        .groupBy(key)
        .agg(F.count_distinct("field_path").alias("n"))
    )


def search_dataset(
    datasets: DataFrame, text: str, platform: str, *, key: str = "urn"
) -> DataFrame:
    """Best match for a name on a platform: equal, then ending in it, then containing it."""
    name, wanted = F.lower("name"), F.lit(text.lower())
    rank = F.when(name == wanted, 1).when(F.endswith(name, wanted), 2).otherwise(3)
    return (
        datasets.where((F.col("platform") == platform) & F.contains(name, wanted))
        .orderBy(rank, key)
        .limit(1)
    )


def allow(df: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Rows whose columns each match one of their patterns, from the start of the text."""
    for name, patterns in rules.items():
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | matches(F.col(name), pattern)
        df = df.where(hit)
    return df


def page(datasets: DataFrame, *, after: str = "", size: int = 50, key: str = "urn") -> DataFrame:
    """The next ``size`` datasets in urn order. Pass the last urn of a page to get the next."""
    return datasets.where(F.col(key) > after).orderBy(key).limit(size)
