"""Tag sets and the run state machine.

Tags are kept in two forms: as ``array<string>`` on catalog rows, and as a change log
``urn, field_path, tag, op, seq`` (``field_path`` is empty for the dataset itself).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DONE_TAG, FAILED, FAILED_TAG, RUN_TAG, SUCCESS, SUCCESS_TAG, TOKENIZED_TAG
from ..functions.names import add_and_remove, leaf_column
from ..session import stored
from .catalog import Catalog, no_tags

ENTITY = ["urn", "field_path", "tag"]

# Tags a dataset gains and loses with the outcome of its run.
DATASET_CHANGES = {
    SUCCESS: {"add": [DONE_TAG, SUCCESS_TAG], "remove": [RUN_TAG, FAILED_TAG]},
    FAILED: {"add": [FAILED_TAG], "remove": [SUCCESS_TAG]},
}


def tag_changes(entities: DataFrame, tag: str, op: str) -> DataFrame:
    """Change-log rows that add a tag to entities ``urn, field_path, seq``, or remove it."""
    if op not in ("add", "remove"):
        raise ValueError(f"A tag change is add or remove, not {op}")
    return entities.select(
        "urn",
        F.coalesce("field_path", F.lit("")).alias("field_path"),
        F.lit(tag).alias("tag"),
        F.lit(op).alias("op"),
        "seq",
    )


def fold_changes(changes: DataFrame, *, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Last change of every tag: ``urn, field_path, tag, op`` and the order columns.

    The partial aggregate is one change per tag, so neither a long history nor a hot dataset
    travels. With one numeric order column it holds only numbers and is a hash aggregate. Folding
    is associative: parts of a log may be folded first. Of two changes with one order, the addition counts.
    """
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    add = F.col("op") == "add"
    last = changes.groupBy(*ENTITY).agg(F.max(F.when(add, by)).alias("add"), F.max(F.when(~add, by)).alias("remove"))
    last = last.withColumn("last", F.greatest("add", "remove"))
    op = F.when(F.col("add") == F.col("last"), F.lit("add")).otherwise(F.lit("remove"))
    names = [F.col("last").alias(order[0])] if len(order) == 1 else [F.col("last")[name].alias(name) for name in order]
    return last.select(*ENTITY, op.alias("op"), *names)


def tag_state(changes: DataFrame) -> DataFrame:
    """Tags in force: ``urn, field_path, tag``."""
    return fold_changes(changes).where("op = 'add'").select(*ENTITY)


def requested(state: DataFrame) -> DataFrame:
    """Run requests in a tag state: ``urn, field_path``; NULL path for a whole dataset."""
    run = state.where(F.col("tag") == RUN_TAG).select("urn", "field_path")
    whole = run.where("field_path = ''").select(
        "urn", F.lit(None).cast("string").alias("field_path")
    )
    parts = run.where("field_path <> ''")
    return whole.unionByName(parts.join(whole.select("urn"), "urn", "left_anti"))


def with_tags(catalog: Catalog, state: DataFrame, removed: DataFrame | None = None) -> Catalog:
    """The catalog with the tags of a tag state added to datasets and fields.

    ``removed`` has tags ``urn, field_path, tag`` that are no longer in force though the catalog may still
    name them. Tags of fields the catalog does not have are ignored.
    """
    rows = state.select(*ENTITY, F.lit(True).alias("on"))
    if removed is not None:
        rows = rows.unionByName(removed.select(*ENTITY, F.lit(False).alias("on")))
    # One entity's distinct tags, at most the vocabulary in size.
    some = [F.collect_set(F.when(on, F.col("tag"))).alias(name) for name, on in (("more", F.col("on")), ("less", ~F.col("on")))]
    sets = rows.groupBy("urn", "field_path").agg(*some)

    def changed(tags: str) -> Column:
        kept = F.array_except(F.coalesce(tags, no_tags()), F.coalesce("less", no_tags()))
        return F.array_sort(F.array_union(kept, F.coalesce("more", no_tags())))

    datasets = (
        catalog.datasets.join(
            sets.where("field_path = ''").select("urn", "more", "less"), "urn", "left"
        )
        .withColumn("global_tags", changed("global_tags"))
        .select(*catalog.datasets.columns)
    )
    fields = (
        catalog.fields.join(sets.where("field_path <> ''"), ["urn", "field_path"], "left")
        .withColumn("tags", changed("tags"))
        .select(*catalog.fields.columns)
    )
    return Catalog(datasets, fields)


def catalog_digests(catalog: Catalog, *, key: str = "urn") -> DataFrame:
    """``key, digest, n`` of the tags of each dataset and its fields, whatever their order.

    Sums of hashes: a hash aggregate of numbers, so a wide dataset is not gathered anywhere.
    """
    own = catalog.datasets.select(key, F.lit("").alias("path"), F.col("global_tags").alias("tags"))
    rows = own.unionByName(catalog.fields.select(key, F.col("field_path").alias("path"), "tags"))
    tags = F.array_sort(F.array_distinct(F.coalesce("tags", no_tags())))
    value = F.xxhash64("path", tags).cast("decimal(20,0)")
    return rows.groupBy(key).agg(F.sum(value).alias("digest"), F.count(F.lit(1)).alias("n"))


def _entity_tags(catalog: Catalog, key: str) -> DataFrame:
    own = catalog.datasets.select(key, F.lit("").alias("field_path"), F.explode("global_tags").alias("tag"))
    fields = catalog.fields.select(key, "field_path", F.explode("tags").alias("tag"))
    return own.unionByName(fields).distinct()


def catalog_changes(old: Catalog, new: Catalog, *, key: str = "urn") -> DataFrame:
    """Tag changes ``key, field_path, tag, op`` that lead from one snapshot of a catalog to another.

    Only datasets whose digest differs are compared tag by tag, so what follows a poll costs as much as
    has changed. Two different datasets with equal 64-bit sums would be taken for equal.
    """
    before, after = catalog_digests(old, key=key), catalog_digests(new, key=key)
    both = before.join(after.withColumnsRenamed({"digest": "_digest", "n": "_n"}), key, "full")
    same = F.col("digest").eqNullSafe(F.col("_digest")) & F.col("n").eqNullSafe(F.col("_n"))
    changed = stored(both.where(~same).select(key), "changed-datasets")
    had, has = (_entity_tags(_only(c, changed, key), key) for c in (old, new))
    on = [key, "field_path", "tag"]
    added = has.join(had, on, "left_anti").withColumn("op", F.lit("add"))
    return added.unionByName(had.join(has, on, "left_anti").withColumn("op", F.lit("remove")))


def _only(catalog: Catalog, keys: DataFrame, key: str) -> Catalog:
    return Catalog(catalog.datasets.join(keys, key, "left_semi"), catalog.fields.join(keys, key, "left_semi"))


def apply_outcomes(
    catalog: Catalog, outcomes: DataFrame, targets: DataFrame, *, key: str = "urn"
) -> Catalog:
    """The catalog after runs. ``outcomes`` has ``key, status``, ``targets`` ``key, column_name``.

    Success: the dataset is done and loses the run tag, target fields are marked tokenized, and
    every field loses the run tag. Failure: the dataset is marked failed; what asked for the run
    stays, so it will be tried again. Datasets without an outcome stay as they are.
    """
    status = outcomes.select(key, "status")
    change = F.col("global_tags")
    for name, tags in DATASET_CHANGES.items():
        new = add_and_remove(F.col("global_tags"), tags["add"], tags["remove"])
        change = F.when(F.col("status") == name, new).otherwise(change)
    datasets = (
        catalog.datasets.join(status, key, "left")
        .withColumn("global_tags", change)
        .select(*catalog.datasets.columns)
    )

    succeeded = status.where(F.col("status") == SUCCESS)
    marked = targets.where(F.col("column_name").isNotNull()).distinct().withColumn(
        "target", F.lit(True)
    )
    tags = F.col("tags")
    new_tags = (
        F.when(F.col("status").isNull(), tags)
        .when(F.col("target"), add_and_remove(tags, [TOKENIZED_TAG], [RUN_TAG]))
        .otherwise(add_and_remove(tags, [], [RUN_TAG]))
    )
    fields = (
        catalog.fields.withColumn("column_name", leaf_column(F.col("field_path")))
        .join(marked.select(key, "column_name", "target"), [key, "column_name"], "left")
        .join(succeeded, key, "left")
        .withColumn("tags", new_tags)
        .select(*catalog.fields.columns)
    )
    return Catalog(datasets, fields)


def outcome_changes(fields: DataFrame, outcomes: DataFrame, targets: DataFrame) -> DataFrame:
    """The same transitions as :func:`apply_outcomes`, as change-log rows ``urn, ..., op``."""

    def rows(df: DataFrame, path: Column, op: str, tags: list[str]) -> DataFrame:
        return df.select(
            "urn",
            path.alias("field_path"),
            F.explode(F.array(*map(F.lit, tags))).alias("tag"),
            F.lit(op).alias("op"),
        )

    parts = []
    for name, tags in DATASET_CHANGES.items():
        ended = outcomes.where(F.col("status") == name)
        parts += [rows(ended, F.lit(""), op, tags[op]) for op in ("remove", "add")]
    succeeded = outcomes.where(F.col("status") == SUCCESS).select("urn")
    touched = fields.join(succeeded, "urn", "left_semi").select(
        "urn", "field_path", leaf_column(F.col("field_path")).alias("column_name"), "tags"
    )
    marked = touched.join(targets.select("urn", "column_name"), ["urn", "column_name"], "left_semi")
    asked = touched.where(F.array_contains("tags", RUN_TAG))
    parts.append(rows(marked, F.col("field_path"), "add", [TOKENIZED_TAG]))
    parts.append(rows(asked, F.col("field_path"), "remove", [RUN_TAG]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
