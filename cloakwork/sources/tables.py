"""Where target tables are read from and written to, by platform.

A platform's ``Tables`` gives the current rows of a table and stores a rewrite of it. The run audit
gets its row after the data are complete, and names the place of the rewritten table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice
from operator import and_, or_
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import UNSUPPORTED_PLATFORM_MESSAGE
from ..session import stored


@dataclass(frozen=True)
class Rewrite:
    """What to store: ``after`` turns current rows, all or some of them, into rewritten ones.

    ``changed`` is the condition on current rows that the run changes. What one call of ``after``
    gives may be used in one query only, because it counts the rows that pass through.
    """

    ref: Row
    run_id: str
    before: DataFrame
    changed: Column
    after: Callable[[DataFrame], DataFrame]
    key_and_targets: list[str]
    limited: bool = False


class Tables(Protocol):
    def read(self, spark: SparkSession, ref: Row, output: str | None) -> DataFrame:
        """Current rows; ``output`` is where the last rewrite went, None if there was none."""

    def write(self, rewrite: Rewrite) -> str:
        """Store a rewritten table and return its place."""


def read_parquet(spark: SparkSession, path: str, parts: list[str] | None = None) -> DataFrame:
    """A parquet table with the columns of all its files and partition values as they are written.

    One file's footer does not stand for the others: schemas are merged, and types that do not go
    together are an error. Partition columns (``parts``, or those that Spark finds in folder names
    below ``path``) are strings, so that ``00`` is not read as 0.
    """
    found = spark.read.option("mergeSchema", "true").parquet(path)
    parts = partition_columns(found) if parts is None else parts
    fields = [T.StructField(f.name, T.StringType()) if f.name in parts else f for f in found.schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def partition_columns(df: DataFrame) -> list[str]:
    """Columns of a table of files that Spark takes from folder names."""
    leaf = df._jdf.queryExecution().analyzed().collectLeaves().head()
    return list(leaf.relation().partitionSchema().fieldNames())


@dataclass(frozen=True)
class ParquetTables:
    """Folders ``source/<database>/<schema>/<table>``; rewrites go to ``target/.../<run_id>``.

    Every version is complete and stays readable. ``partition_by`` names the partition columns of
    tables (``schema.table``) that have some.
    """

    source: str
    target: str
    partition_by: dict[str, list[str]] = field(default_factory=dict)

    def read(self, spark: SparkSession, ref: Row, output: str | None) -> DataFrame:
        parts = self.partition_by.get(f"{ref.schema_name}.{ref.table_name}")
        return read_parquet(spark, output or f"{self.source}/{_folder(ref)}", parts)

    def write(self, rewrite: Rewrite) -> str:
        ref = rewrite.ref
        path = f"{self.target}/{_folder(ref)}/{rewrite.run_id}"
        writer = rewrite.after(rewrite.before).write.mode("errorifexists")
        parts = self.partition_by.get(f"{ref.schema_name}.{ref.table_name}")
        (writer.partitionBy(*parts) if parts else writer).parquet(path)
        return path


@dataclass(frozen=True)
class PartitionedTables:
    """Partitioned parquet folders ``root/<database>/<schema>/<table>``, rewritten in place.

    Only partitions that hold a row to change are read in full and replaced, so the cost follows
    the new plaintext and not the table. Spark stages the new files and moves them when the job
    commits. A commit cut short leaves whole old or whole new partitions, or a partition's new
    files in the staging folder; tokens being stable, the next run completes the rest.
    """

    root: str
    partition_by: dict[str, list[str]]
    # Partitions replaced by one job: a long condition would slow planning.
    wave: int = 500

    def read(self, spark: SparkSession, ref: Row, output: str | None) -> DataFrame:
        parts = self.partition_by[f"{ref.schema_name}.{ref.table_name}"]
        return read_parquet(spark, f"{self.root}/{_folder(ref)}", parts)

    def write(self, rewrite: Rewrite) -> str:
        ref, rows = rewrite.ref, rewrite.before
        parts = self.partition_by[f"{ref.schema_name}.{ref.table_name}"]
        touched = stored(rows.where(rewrite.changed).select(*parts).distinct(), "touched")
        path = f"{self.root}/{_folder(ref)}"
        listed = touched.toLocalIterator()
        while wave := list(islice(listed, self.wave)):
            part = rows.where(reduce(or_, [equal(parts, values) for values in wave]))
            rewrite.after(part).write.mode("overwrite").partitionBy(*parts).option(
                "partitionOverwriteMode", "dynamic"
            ).parquet(path)
        return path


@dataclass(frozen=True)
class CatalogTables:
    """Tables of the session's catalog; a rewrite is a new table ``<name>_<run_id>``."""

    format: str = "parquet"

    def read(self, spark: SparkSession, ref: Row, output: str | None) -> DataFrame:
        return spark.table(output or f"`{ref.schema_name}`.`{ref.table_name}`")

    def write(self, rewrite: Rewrite) -> str:
        ref = rewrite.ref
        name = f"`{ref.schema_name}`.`{ref.table_name}_{rewrite.run_id.replace('-', '')}`"
        rows = rewrite.after(rewrite.before)
        rows.write.format(self.format).mode("errorifexists").saveAsTable(name)
        return name


@dataclass(frozen=True)
class DataSourceTables:
    """Any Spark data source that addresses tables by option, such as ``jdbc``.

    ``options`` are passed on as they are (URL, credentials, partitioning of the read). Spark
    cannot update rows there, so key and target columns of the changed rows, and no others, go to
    a table ``<schema>.<table>_<run_id>``; updating from it by key is a step of the database.
    """

    format: str
    options: dict[str, str] = field(default_factory=dict)
    table_option: str = "dbtable"

    def read(self, spark: SparkSession, ref: Row, output: str | None) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        return reader.option(self.table_option, f"{ref.schema_name}.{ref.table_name}").load()

    def write(self, rewrite: Rewrite) -> str:
        ref = rewrite.ref
        table = f"{ref.schema_name}.{ref.table_name}_{rewrite.run_id.replace('-', '')}"
        rows = rewrite.after(rewrite.before.where(rewrite.changed))
        writer = rows.select(*rewrite.key_and_targets).write.format(self.format)
        writer.options(**self.options).option(self.table_option, table).mode("errorifexists").save()
        return table


def _folder(ref: Row) -> str:
    return f"{ref.database}/{ref.schema_name}/{ref.table_name}"


def equal(columns: list[str], values: Row) -> Column:
    """Condition that columns have the values of a row, NULLs included."""
    return reduce(and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, values)])


class UnsupportedPlatform(ValueError):
    """No tables are registered for a platform."""


def tables_of(platforms: dict[str, Tables], platform: str) -> Tables:
    if platform not in platforms:
        raise UnsupportedPlatform(UNSUPPORTED_PLATFORM_MESSAGE % platform)
    return platforms[platform]
