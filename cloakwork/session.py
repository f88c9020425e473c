"""Session and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, **settings: str
) -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own.

    Further settings are given with underscores for dots: ``spark_sql_warehouse_dir="/x"``.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cloakwork")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


_local_roots: dict[str, str] = {}
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def workspace(spark: SparkSession, purpose: str) -> str:
    """A new folder for written intermediate tables, under ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only where that setting is missing and the session
    runs in this one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master").startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share")
        app = spark.conf.get("spark.app.id")
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="cloakwork-")
        root = _local_roots[app]
    path = f"{root.rstrip('/')}/cloakwork/{purpose}-{uuid.uuid4().hex}"
    if (paths := _written.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables that are written inside, once nothing reads them any more.

    For loops: what a step leaves behind would grow with every turn. Only this thread's tables count,
    and those of threads that were given a copy of its context.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once and read back: for inputs that a plan reads several times.

    This cuts the lineage, and unlike cached blocks the files outlive lost executors.
    """
    spark = df.sparkSession
    path = workspace(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few rows of this process, such as the statuses of a wave of runs.

    Passed as Arrow, so the plan is a local scan in one partition and starts no Python worker.
    """
    fields = StructType.fromDDL(schema)
    records = [dict(zip(fields.names, row, strict=True)) for row in rows]
    table = pa.Table.from_pylist(records, schema=to_arrow_schema(fields))
    return spark.createDataFrame(table, fields)
