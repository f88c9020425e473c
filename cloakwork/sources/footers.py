"""Files and schemas of parquet tables, found by tasks: one folder level at a time, one footer a file.

Workers list folders and open footers through ``pyarrow.fs``; a task sends rows, never whole tables.
As in Spark's own reader, names that begin with ``.`` or ``_`` are hidden unless they are partitions,
and partition columns come last, as strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import allow
from ..session import local_rows, stored

CRAWL_SCHEMA = (
    "platform string, database string, schema_name string, table_name string, "
    "location string, pos int, field_path string, native_data_type string, problem string"
)
#: Problem of a table that only Spark's own reader can describe.
BY_SPARK = "by spark"
#: Problem of a table whose files have types that do not go together.
CONFLICT = "TypesDoNotMerge"

_FILES = "path string, folder boolean, size long, modified long"
_FOOTERS = "path string, size long, modified long, schema string, problem string"
_SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
_ROWS = 10_000


def field_rows(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """Path and type of every column; fields of structs follow with dotted paths."""
    rows = []
    for f in schema.fields:
        path = prefix + f.name
        rows.append((path, f.dataType.simpleString()))
        if isinstance(f.dataType, T.StructType):
            rows += field_rows(f.dataType, path + ".")
    return rows


def qualified(spark: SparkSession, place: str) -> str:
    """A folder's location with its file system, as Hadoop's settings resolve it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.rstrip("/")


def opened(location: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified location, and the location's path in it."""
    scheme, host, path = _taken_apart(location)
    if scheme == "file":
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")[0], path


def _taken_apart(location: str) -> tuple[str, str, str]:
    """Scheme, host and path; object stores have their bucket in front of the path."""
    scheme, _, rest = location.partition(":")
    host, _, path = rest.removeprefix("//").partition("/") if rest.startswith("//") else ("", "", rest.lstrip("/"))
    return scheme, host, f"/{path}" if scheme in ("file", "hdfs", "viewfs") else f"{host}/{path}"


def can_list(spark: SparkSession, root: str) -> bool:
    """Whether ``pyarrow.fs`` knows the file system of a folder and finds the folder there."""
    try:
        files, path = opened(qualified(spark, root))
        return files.get_file_info(path).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(folders: DataFrame, base: str) -> DataFrame:
    """What lies directly in each folder (``path`` from ``base`` on), hidden names left out.

    A folder that is gone meanwhile has no entries. The entries of one folder are one task's.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = opened(base)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                inside = f"{top}/{folder}" if folder else top
                found = iter(files.get_file_info(fs.FileSelector(inside, allow_not_found=True)))
                while part := list(islice(found, _ROWS)):
                    part = [f for f in part if not _hidden(f.base_name)]
                    columns = [
                        pa.array([f"{folder}/{f.base_name}" if folder else f.base_name for f in part], pa.string()),
                        pa.array([f.type == fs.FileType.Directory for f in part], pa.bool_()),
                        pa.array([f.size for f in part], pa.int64()),
                        pa.array([f.mtime_ns for f in part], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "folder", "size", "modified"])

    return folders.select("path").mapInArrow(listed, _FILES)


def table_files(spark: SparkSession, root: str, tables: list[str] | None = None) -> DataFrame:
    """``top, path, size, modified, parts, nested``: every file of the tables directly under a folder.

    ``top`` is the table's file or folder, ``path`` is qualified, ``parts`` are its partition columns,
    ``nested`` tells that a folder on the way is no partition. There is a job for each level of
    folders, whose folders are dealt over all tasks.
    """
    base = qualified(spark, root)
    tasks = spark.sparkContext.defaultParallelism
    level = stored(_entries(local_rows(spark, [("",)], "path string"), base), "listed")
    name = F.regexp_replace("path", r"\.parquet\z", "")
    if tables is not None:
        level = allow(level.withColumn("table_name", name), {"table_name": tables}).drop("table_name")
    files = level.where(~F.col("folder") & F.col("path").endswith(".parquet"))
    while not (folders := level.where("folder")).isEmpty():
        level = stored(_entries(folders.repartition(tasks, "path"), base), "listed")
        files = files.union(level.where("NOT folder"))
    steps = F.split("path", "/")
    between = F.slice(steps, 2, F.greatest(F.size(steps) - 2, F.lit(0)))
    found = files.select(
        steps[0].alias("top"), F.concat(F.lit(base + "/"), "path").alias("path"), "size", "modified",
        F.transform(between, lambda step: F.substring_index(step, "=", 1)).alias("parts"),
        F.exists(between, lambda step: ~step.contains("=")).alias("nested"),
    )
    real = found.where(F.col("path").endswith(".parquet")).select("top").distinct()
    return stored(found.join(real, "top", "left_semi"), "files")


def _plain(kind: pa.DataType) -> T.DataType | None:
    """Spark's type of an Arrow type for which no setting of Spark's reader matters; else None."""
    t = pa.types
    simple = [
        (t.is_boolean, T.BooleanType()), (t.is_int8, T.ByteType()), (t.is_int16, T.ShortType()), (t.is_int32, T.IntegerType()),
        (t.is_int64, T.LongType()), (t.is_uint8, T.ShortType()), (t.is_uint16, T.IntegerType()), (t.is_uint32, T.LongType()),
        (t.is_float32, T.FloatType()), (t.is_float64, T.DoubleType()), (t.is_date32, T.DateType()),
        (t.is_string, T.StringType()), (t.is_large_string, T.StringType()), (t.is_binary, T.BinaryType()),
        (t.is_large_binary, T.BinaryType()),
    ]
    for fits, spark_type in simple:
        if fits(kind):
            return spark_type
    if t.is_decimal128(kind):
        return T.DecimalType(kind.precision, kind.scale)
    if t.is_timestamp(kind) and kind.unit in ("ms", "us"):
        return T.TimestampType() if kind.tz else T.TimestampNTZType()
    if t.is_list(kind) or t.is_large_list(kind):
        inner = _plain(kind.value_type)
        return inner and T.ArrayType(inner)
    if t.is_struct(kind):
        return _plain_struct([kind.field(i) for i in range(kind.num_fields)])
    if t.is_map(kind):
        key, value = _plain(kind.key_type), _plain(kind.item_type)
        return T.MapType(key, value) if key and value else None
    return None


def _plain_struct(fields: list[pa.Field]) -> T.StructType | None:
    kinds = [_plain(f.type) for f in fields]
    return None if None in kinds else T.StructType([T.StructField(f.name, k) for f, k in zip(fields, kinds)])


def _footer(files: fs.FileSystem, path: str) -> tuple[str | None, str | None]:
    """Schema of a file as Spark's JSON, or what is the matter with it."""
    try:
        with files.open_input_file(path) as file:
            meta = pq.read_metadata(file)
        written = (meta.metadata or {}).get(_SPARK_SCHEMA)
        if written is not None:
            return written.decode(), None
        plain = _plain_struct(list(meta.schema.to_arrow_schema()))
    except (pa.ArrowException, OSError) as error:
        return None, type(error).__name__
    return (plain.json(), None) if plain is not None else (None, BY_SPARK)


def file_schemas(files: DataFrame, cache: str | None = None) -> DataFrame:
    """``path, size, modified, schema, problem`` of files, from their footers or from ``cache``.

    New footers are added to ``cache`` before they are used; those of unreadable files are not kept.
    """
    spark = files.sparkSession
    key = ["path", "size", "modified"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[tuple[str, str], fs.FileSystem] = {}
        for batch in batches:
            found = []
            for location in batch.column("path").to_pylist():
                scheme, host, path = _taken_apart(location)
                if (scheme, host) not in systems:
                    systems[scheme, host] = opened(location)[0]
                found.append(_footer(systems[scheme, host], path))
            columns = [batch.column(name) for name in key]
            columns += [pa.array([schema for schema, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "schema", "problem"])

    def footers(rows: DataFrame) -> DataFrame:
        tasks = spark.sparkContext.defaultParallelism
        return stored(rows.select(*key).repartition(tasks, "path").mapInArrow(read, _FOOTERS), "footers")

    if cache is None:
        return footers(files)
    local_rows(spark, [], _FOOTERS).limit(0).write.mode("ignore").parquet(cache)
    kept = spark.read.schema(_FOOTERS).parquet(cache).dropDuplicates(key)
    new = footers(files.join(kept, key, "left_anti"))
    old = stored(kept.join(files.select(*key), key, "left_semi"), "known-footers")
    lasting = new.where(F.col("problem").isNull() | (F.col("problem") == BY_SPARK))
    if not lasting.isEmpty():
        lasting.write.mode("append").parquet(cache)
    return old.unionByName(new)


def table_schemas(files: DataFrame) -> DataFrame:
    """``top, schema, parts, nested, problem, path``: each different footer of a table, with its first file.

    Files are counted down to footers before the shuffle, so a table with most of the files is no hot key.
    """
    return files.groupBy("top", "schema", "parts", "nested", "problem").agg(F.min("path").alias("path"))


def _merged(left: T.DataType, right: T.DataType) -> T.DataType:
    """One type for both, as when Spark merges schemas: fields by name, new ones last, else equal types."""
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        fields = {f.name.lower(): f for f in left.fields}
        for f in right.fields:
            own = fields.get(f.name.lower())
            fields[f.name.lower()] = T.StructField(own.name, _merged(own.dataType, f.dataType)) if own else f
        return T.StructType(list(fields.values()))
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        return T.ArrayType(_merged(left.elementType, right.elementType))
    if isinstance(left, T.MapType) and isinstance(right, T.MapType):
        return T.MapType(_merged(left.keyType, right.keyType), _merged(left.valueType, right.valueType))
    if left != right:
        raise TypeError(f"{left.simpleString()} and {right.simpleString()}")
    return left


def _described(found: list[dict]) -> tuple[list[tuple[str, str]], str | None]:
    """Columns of a table with these different footers, or what is the matter with it."""
    unreadable = sorted({f["problem"] for f in found if f["problem"] not in (None, BY_SPARK)})
    if unreadable:
        return [], unreadable[0]
    parts = [unquote(p) for p in found[0]["parts"]]
    if any(f["problem"] or f["nested"] or f["parts"] != found[0]["parts"] for f in found) or len(set(parts)) < len(parts):
        return [], BY_SPARK
    schema = T.StructType([])
    try:
        for f in sorted(found, key=lambda f: f["path"]):
            schema = _merged(schema, T.StructType.fromJson(json.loads(f["schema"])))
    except TypeError:
        return [], CONFLICT
    if {p.lower() for p in parts} & {f.name.lower() for f in schema.fields}:
        return [], BY_SPARK
    return field_rows(T.StructType(schema.fields + [T.StructField(p, T.StringType()) for p in parts])), None


def merged_columns(schemas: DataFrame, root: str, place: tuple[str, str, str]) -> DataFrame:
    """Catalog rows of every table; a table's different footers meet in one task."""
    prefix = root.rstrip("/") + "/"
    kinds = [f.dataType for f in T.StructType.fromDDL(CRAWL_SCHEMA).fields]
    types = [pa.int32() if isinstance(k, T.IntegerType) else pa.string() for k in kinds]
    names = T.StructType.fromDDL(CRAWL_SCHEMA).fieldNames()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for table in batch.to_pylist():
                own = (*place, table["top"].removesuffix(".parquet"), prefix + table["top"])
                columns, problem = _described(table["found"])
                rows += [(*own, pos, *column, None) for pos, column in enumerate(columns)]
                if problem:
                    rows.append((*own, None, None, None, problem))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    found = schemas.groupBy("top").agg(F.collect_list(F.struct("path", "schema", "parts", "nested", "problem")).alias("found"))
    return found.mapInArrow(describe, CRAWL_SCHEMA)
