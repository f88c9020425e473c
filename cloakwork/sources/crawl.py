"""Registering tables in a catalog: one row per column, read from schemas, never from data."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import dataset_urn
from ..operators.catalog import Catalog, allow, no_tags
from ..session import local_rows, stored, workspace
from .footers import (
    BY_SPARK, CRAWL_SCHEMA, can_list, field_rows, file_schemas, merged_columns, table_files, table_schemas,
)
from .tables import read_parquet

_PAGE = 500
_READERS = 16


def crawl_parquet(
    spark: SparkSession,
    root: str,
    *,
    platform: str = "parquet",
    database: str = "default",
    schema_name: str = "default",
    tables: list[str] | None = None,
    cache: str | None = None,
) -> DataFrame:
    """Columns of the parquet tables under a folder; ``tables`` holds allow patterns for names.

    A table is a file ``name.parquet`` or a folder with such files. Folders are listed and footers
    read by tasks, and a table's different schemas are merged in one of them, so neither files nor
    schemas pass through the driver. ``cache`` is a folder that keeps footers: files with a known
    path, size and time are not opened again. It grows with the files ever seen and may be deleted.

    A table that cannot be read has one row without a column, whose ``problem`` says why. Tables with
    types that only Spark can name, or with folders that are not partitions, are described by Spark's
    own reader on the driver; so is everything where workers cannot open the file system.
    """
    place = (platform, database, schema_name)
    if not can_list(spark, root):
        return _register(spark, _tables_listed_by_spark(spark, root, tables), place, _parquet_columns(spark))
    files = table_files(spark, root, tables)
    known = table_schemas(files.join(file_schemas(files, cache), ["path", "size", "modified"]))
    merged = stored(merged_columns(known, root, place), "crawl-merged")
    odd = merged.where(F.col("problem") == BY_SPARK).select("table_name", "location")
    plain = merged.where(F.coalesce(F.col("problem") != BY_SPARK, F.lit(True)))
    return plain.unionByName(_register(spark, odd, place, _parquet_columns(spark)))


def _tables_listed_by_spark(spark: SparkSession, root: str, tables: list[str] | None) -> DataFrame:
    """``location, table_name``; all file names of the folder pass through the driver."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )
    prefix = root.rstrip("/") + "/"
    top = F.substring_index(F.substring_index("path", prefix, -1), "/", 1)
    found = files.select(
        F.concat(F.lit(prefix), top).alias("location"),
        F.regexp_replace(top, r"\.parquet\z", "").alias("table_name"),
    ).distinct()
    return found if tables is None else allow(found, {"table_name": tables})


def _parquet_columns(spark: SparkSession) -> Callable[[Row], T.StructType]:
    return lambda table: read_parquet(spark, table.location).schema


def crawl_database(
    spark: SparkSession,
    schema_name: str,
    *,
    platform: str = "spark",
    tables: list[str] | None = None,
) -> DataFrame:
    """Columns of the tables of a database of the session's own catalog."""
    listed = spark.catalog.listTables(schema_name)
    names = local_rows(
        spark, [(t.name, f"{schema_name}.{t.name}") for t in listed if not t.isTemporary], "table_name string, location string"
    )
    if tables is not None:
        names = allow(names, {"table_name": tables})
    place = (platform, spark.catalog.currentCatalog(), schema_name)
    return _register(spark, names, place, lambda table: spark.table(table.location).schema)


def _register(
    spark: SparkSession, tables: DataFrame, place: tuple[str, str, str], schema_of: Callable[[Row], T.StructType]
) -> DataFrame:
    """Written catalog rows of ``table_name, location``, a page of tables at a time."""

    def rows_of(table: Row) -> list[tuple]:
        own = (*place, table.table_name, table.location)
        try:
            return [(*own, pos, *column, None) for pos, column in enumerate(field_rows(schema_of(table)))]
        except (PySparkException, Py4JJavaError) as error:
            return [(*own, None, None, None, type(error).__name__)]

    path = workspace(spark, "crawl")
    local_rows(spark, [], CRAWL_SCHEMA).write.parquet(path)
    listed = tables.toLocalIterator()
    with ThreadPoolExecutor(_READERS) as pool:  # waiting for footers, not computing
        while page := list(islice(listed, _PAGE)):
            rows = [row for columns in pool.map(rows_of, page) for row in columns]
            local_rows(spark, rows, CRAWL_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CRAWL_SCHEMA).parquet(path)


def to_catalog(crawled: DataFrame, env: str = "PROD") -> Catalog:
    """Catalog rows of crawled columns, without tags. Tables that could not be read are left out."""
    crawled = crawled.where("problem IS NULL") if "problem" in crawled.columns else crawled
    name = F.concat_ws(".", "database", "schema_name", "table_name")
    rows = crawled.select(
        dataset_urn(F.col("platform"), name, F.lit(env)).alias("urn"),
        name.alias("name"),
        "platform",
        "location",
        "pos",
        "field_path",
        "native_data_type",
    )
    empty = F.map_from_arrays(no_tags(), no_tags())
    datasets = (
        rows.select("urn", "name", "platform", "location")
        .distinct()
        .withColumns({"global_tags": no_tags(), "properties": empty})
    )
    fields = rows.select("urn", "pos", "field_path", "native_data_type").withColumn(
        "tags", no_tags()
    )
    return Catalog(datasets, fields)
