"""Tables that keep their name: after a run their plaintext is gone.

:class:`FileTables` replaces single files of a folder, :class:`PublishedTables` points a catalog's table,
or single partitions of it, to a new version. Both

* find out in one aggregate which files hold a row to change, and read and write no others;
* read back what they have written and compare it, rows and values, with what they meant to write;
* compare names, sizes and times of the files they have read with those that are there when they
  publish. A difference is a :class:`Conflict`: the run fails, nothing of that step is published, and the
  dataset stays asked for.

Until the last step all new files are in folders that readers of the table do not see, so a run cut
short leaves the table as it was, or part of its files or partitions in their new version, whole.
Tokens are stable, so the next run completes the rest.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..operators.rewrite import RewriteError
from ..session import local_rows, stored
from .tables import Rewrite, equal, partition_columns, read_parquet

FILE_SCHEMA = "path string, size bigint, modified bigint"
RETIRED_SCHEMA = "name string, spec string, place string, retired_at timestamp"
_SAME = ["path", "size", "modified"]
_NUMBER = "_cloakwork_file"
_THREADS = 16


class Conflict(RewriteError):
    """The table changed while it was being rewritten."""


class WrongCopy(RewriteError):
    """What was written is not what was meant to be written."""


# --- files ---------------------------------------------------------------------------------------


def file_counts(df: DataFrame, changed: Column) -> DataFrame:
    """``path, size, modified, number, rows, changed`` of every file that rows of ``df`` come from.

    One pass over the columns of the condition; a task sends one row per file.
    """
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(changed).alias("changed")]
    found = df.groupBy(*_file_columns(df)).agg(*counts)
    return found.select(*_SAME, F.xxhash64("path").alias("number"), "rows", "changed")


def _file_columns(df: DataFrame) -> list[Column]:
    file = df.metadataColumn("_metadata")
    modified = F.unix_millis(file["file_modification_time"])
    return [file["file_path"].alias("path"), file["file_size"].alias("size"), modified.alias("modified")]


def listed_files(spark: SparkSession, *places: str) -> DataFrame:
    """``path, size, modified`` of the files that readers of these folders see now. Nothing is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([literal_path(p) for p in places])
    return files.select(*_file_columns(files))


def literal_path(path: str) -> str:
    """A path that Spark takes as it is, without wildcards."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


class Files:
    """The files of a store, by Hadoop's own interface."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._overwrite = spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        self._overwrite[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE

    def path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def decoded(self, uri: str) -> str:
        """A path as it is, from its form in ``_metadata``."""
        return self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(uri)).toString()

    def status(self, name: str) -> tuple[int, int] | None:
        """Size and time (milliseconds) of a file, None if there is none."""
        path = self.path(name)
        store = path.getFileSystem(self._conf)
        if not store.exists(path):
            return None
        found = store.getFileStatus(path)
        return found.getLen(), found.getModificationTime()

    def names(self, folder: str) -> list[str]:
        """Data files directly in a folder."""
        path = self.path(folder)
        store = path.getFileSystem(self._conf)
        if not store.exists(path):
            return []
        found = (f.getPath() for f in store.listStatus(path) if f.isFile())
        return [f.toString() for f in found if not f.getName().startswith(("_", "."))]

    def replace(self, new: str, old: str) -> None:
        """Gives the file ``new`` the name ``old`` in one step; readers see one or the other."""
        source, target = self.path(new), self.path(old)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        context.rename(source, target, self._overwrite)

    def remove(self, folder: str) -> bool:
        path = self.path(folder)
        return path.getFileSystem(self._conf).delete(path, True)


def whole_files_session(spark: SparkSession, largest: int) -> SparkSession:
    """A session with the same settings whose tasks read one whole file each and write one."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.files.maxPartitionBytes", str(max(largest, 1) + 1))
    own.conf.set("spark.sql.files.openCostInBytes", str(max(largest, 1) + 1))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    own.conf.unset("spark.sql.files.maxPartitionNum")
    own.conf.set("spark.sql.files.maxRecordsPerFile", "0")
    own.conf.set("spark.sql.maxConcurrentOutputFileWriters", "16")  # no sort by file before the write
    return own


def _hashed(data_type: T.DataType) -> bool:
    text = data_type.simpleString()
    return not any(kind in text for kind in ("map<", "variant", "geometry", "geography"))


def _digest(df: DataFrame, columns: list[str]) -> list[Column]:
    """Rows, and a sum of hashes of all values, which any order and any cut into files give alike."""
    plain = [quoted(c) for c in columns if _hashed(df.schema[c].dataType)]
    hashes = F.xxhash64(*map(F.col, plain)) if plain else F.lit(0)
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hashes.cast("decimal(20,0)")), F.lit(0)).alias("hashes")]


def _write_checked(df: DataFrame, columns: list[str], path: str, by: list[str]) -> DataFrame:
    """Rows written to ``path`` in folders ``by``; raises unless they read back as they were."""
    meant = Observation()
    df.observe(meant, *_digest(df, columns)).write.partitionBy(*by).parquet(path)
    schema = T.StructType([df.schema[c] for c in [*columns, *(b for b in by if b not in columns)]])
    back = df.sparkSession.read.schema(schema).parquet(literal_path(path))
    if back.agg(*_digest(back, columns)).first().asDict() != meant.get:
        raise WrongCopy("The new version does not read back as it was written")
    return back


# --- folders -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FileTables:
    """Parquet folders ``root/<database>/<schema>/<table>``, partitioned or not, rewritten file by file.

    A file that holds a row to change is read by one task, written to a hidden folder of the table, and
    takes the old file's name in one step, so the cost follows the files with plaintext. All other
    files stay byte for byte, and a table is never without a row or with one twice. Files that arrive
    during the run are looked at before it ends; if they keep arriving, the run fails.

    A query that listed the table before a replacement and opens the file after it has the wrong size in
    hand. Stores where such queries must go on undisturbed need :class:`PublishedTables`.
    """

    root: str
    partition_by: dict[str, list[str]] = field(default_factory=dict)
    #: Files rewritten by one job.
    wave: int = 500
    #: How often files that arrived during the run are looked for.
    rounds: int = 5

    def read(self, spark: SparkSession, ref: Row, output: str | None) -> DataFrame:
        return read_parquet(spark, self._folder(ref), self.partition_by.get(f"{ref.schema_name}.{ref.table_name}"))

    def write(self, rewrite: Rewrite) -> str:
        spark, folder = rewrite.before.sparkSession, self._folder(rewrite.ref)
        files = Files(spark)
        known = local_rows(spark, [], FILE_SCHEMA)
        df = rewrite.before
        for _ in range(self.rounds):
            counts = stored(file_counts(df, rewrite.changed), "files")
            known = known.union(counts.select(*_SAME)).union(self._replace(rewrite, df, counts, files, folder))
            if rewrite.limited:
                return folder
            known = stored(known, "known-files")
            arrived = stored(listed_files(spark, folder).join(known, _SAME, "left_anti"), "arrived")
            if arrived.isEmpty():
                return folder
            known = known.union(arrived)  # a file without rows has no counts, however often it is read
            df = self.read(spark, rewrite.ref, None)
            file = df.metadataColumn("_metadata")["file_path"]
            new = arrived.select(F.col("path").alias("_arrived"))
            df = df.join(new, file == F.col("_arrived"), "left_semi")
        raise Conflict("Files keep arriving in the table")

    def _replace(self, rewrite: Rewrite, df: DataFrame, counts: DataFrame, files: Files, folder: str) -> DataFrame:
        """Replaces the files with rows to change, wave after wave. Returns the new ones."""
        spark = df.sparkSession
        parts = partition_columns(df)
        columns = [c for c in df.columns if c not in parts]
        new: DataFrame = local_rows(spark, [], FILE_SCHEMA)
        touched = counts.where("changed > 0").orderBy("path").toLocalIterator()
        number = 0
        while wave := _different(touched, self.wave):
            staging = f"{folder}/_rewrite/{rewrite.run_id}-{number}"
            number += 1
            own = whole_files_session(spark, max(f.size for f in wave))
            names = {f.number: files.decoded(f.path) for f in wave}
            reader = own.read.schema(df.schema).option("basePath", literal_path(folder))
            rows = reader.parquet(*map(literal_path, names.values()))
            rows = rows.withColumn(_NUMBER, F.xxhash64(rows.metadataColumn("_metadata")["file_path"]))
            after = rewrite.after(rows).select(*map(quoted, columns), _NUMBER)
            back = _write_checked(after, columns, staging, [_NUMBER])
            written = {row[_NUMBER]: row["count"] for row in back.groupBy(_NUMBER).count().collect()}
            places = {n: files.names(f"{staging}/{_NUMBER}={n}") for n in names}
            for f in wave:
                if len(places[f.number]) != 1 or written[f.number] != f.rows:
                    raise Conflict("A file changed between two reads")
            with ThreadPoolExecutor(_THREADS) as pool:
                list(pool.map(lambda f: _unchanged(files, names[f.number], f), wave))
                made = list(pool.map(lambda f: _publish(files, names[f.number], places[f.number][0], f), wave))
            files.remove(staging)
            new = new.union(local_rows(spark, made, FILE_SCHEMA))
        files.remove(f"{folder}/_rewrite")
        return new

    def _folder(self, ref: Row) -> str:
        return f"{self.root}/{ref.database}/{ref.schema_name}/{ref.table_name}"


def _unchanged(files: Files, name: str, noted: Row) -> None:
    if files.status(name) != (noted.size, noted.modified):
        raise Conflict("A file of the table changed during the run")


def _publish(files: Files, name: str, new: str, noted: Row) -> tuple:
    _unchanged(files, name, noted)
    files.replace(new, name)
    return (noted.path, *files.status(name))


def _different(rows: Iterator[Row], most: int) -> list[Row]:
    """Up to ``most`` files, of different numbers."""
    wave, numbers = [], set()
    for row in islice(rows, most):
        if row.number in numbers:
            raise RewriteError("Two files of the table have one number")  # a collision of 64-bit hashes
        numbers.add(row.number)
        wave.append(row)
    return wave


# --- tables of the catalog -----------------------------------------------------------------------


@dataclass(frozen=True)
class PublishedTables:
    """Parquet tables of the session's catalog, read by their own name before and after.

    The new version is written beside the old one and verified; then the table's location, or that of
    each partition with rows to change, is set to it. Queries that have begun go on with the old files.
    Old places are noted in ``retired``, a folder; :func:`remove_retired` deletes them later. Until then
    they hold the plaintext.
    """

    retired: str
    #: Partitions rewritten by one job.
    wave: int = 200

    def read(self, spark: SparkSession, ref: Row, output: str | None) -> DataFrame:
        return spark.table(_name(ref))

    def write(self, rewrite: Rewrite) -> str:
        spark, name = rewrite.before.sparkSession, _name(rewrite.ref)
        parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
        counts = stored(file_counts(rewrite.before, rewrite.changed), "files")
        if parts:
            self._swap_partitions(rewrite, name, parts, counts)
        else:
            place = _location(spark, name)
            new = _beside(place, rewrite.run_id)
            df = rewrite.after(rewrite.before)
            _write_checked(df, df.columns, new, [])
            self._retire(spark, [(name, "", place)])
            _same_files(spark, counts, [place])
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{_escaped(new)}'")
        spark.catalog.refreshTable(name)
        return name

    def _swap_partitions(self, rewrite: Rewrite, name: str, parts: list[str], counts: DataFrame) -> None:
        before, spark = rewrite.before, rewrite.before.sparkSession
        touched = stored(before.where(rewrite.changed).select(*map(quoted, parts)).distinct(), "touched")
        rows, number, new_root = touched.toLocalIterator(), 0, _beside(_location(spark, name), rewrite.run_id)
        while wave := list(islice(rows, self.wave)):
            df = rewrite.after(before.where(reduce(or_, [equal(parts, values) for values in wave])))
            back = _write_checked(df, df.columns, f"{new_root}-{number}", parts)
            number += 1
            folders = _folders(back, parts)
            specs = [", ".join(f"{quoted(p)} = {_constant(v)}" for p, v in zip(parts, row)) for row in wave]
            places = [_location(spark, name, spec) for spec in specs]
            self._retire(spark, [(name, spec, place) for spec, place in zip(specs, places)])
            _same_files(spark, counts, places)
            for spec, row in zip(specs, wave):
                spark.sql(f"ALTER TABLE {name} PARTITION ({spec}) SET LOCATION '{_escaped(folders[tuple(row)])}'")

    def _retire(self, spark: SparkSession, rows: list[tuple]) -> None:
        """Notes places before they go out of use, so that none is forgotten."""
        noted = local_rows(spark, rows, "name string, spec string, place string")
        noted.withColumn("retired_at", F.current_timestamp()).write.mode("append").parquet(self.retired)


def remove_retired(spark: SparkSession, retired: str, older_than: float) -> int:
    """Deletes old versions noted more than ``older_than`` seconds ago; returns their number.

    What its table or partition still points to stays: a run may have ended between note and swap.
    """
    log = spark.read.schema(RETIRED_SCHEMA).parquet(retired)
    latest = log.groupBy("name", "spec", "place").agg(F.max("retired_at").alias("at"))
    old = latest.where(F.unix_millis("at") < F.lit(int((time.time() - older_than) * 1000)))
    files, removed = Files(spark), 0
    for row in stored(old, "retired").toLocalIterator():
        if files.path(_location(spark, row.name, row.spec)).equals(files.path(row.place)):
            continue
        removed += files.remove(row.place)
    return removed


def _same_files(spark: SparkSession, counts: DataFrame, places: list[str]) -> None:
    """Raises unless the folders hold the files that were read, and no other rows."""
    files = Files(spark)
    roots = [files.path(p).toUri().getRawPath().rstrip("/") + "/" for p in places]
    inside = F.regexp_replace("path", "^[^:/]+:(//[^/]*)?", "")
    read = counts.where(reduce(or_, [inside.startswith(root) for root in roots]))
    there = stored(listed_files(spark, *places), "listed")
    if not read.join(there, _SAME, "left_anti").isEmpty():
        raise Conflict("A file of the table changed during the run")
    for row in there.join(counts, _SAME, "left_anti").toLocalIterator():
        if not spark.read.parquet(literal_path(files.decoded(row.path))).isEmpty():
            raise Conflict("Files arrived in the table during the run")


def _folders(written: DataFrame, parts: list[str]) -> dict[tuple, str]:
    """Where each partition was written to."""
    files = Files(written.sparkSession)
    folder = F.regexp_replace(written.metadataColumn("_metadata")["file_path"], "/[^/]*$", "")
    found = written.select(*map(quoted, parts), folder.alias("_folder")).distinct().collect()
    return {tuple(row)[:-1]: files.decoded(row[-1]) for row in found}


def _constant(value: Any) -> str:
    return "null" if value is None else f"'{_escaped(str(value))}'"


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _beside(place: str, run_id: str) -> str:
    """A new folder beside the table's first one."""
    first = re.sub(r"__v[0-9a-f]{32}\Z", "", place.rstrip("/"))
    return f"{first}__v{run_id.replace('-', '')}"


def _location(spark: SparkSession, name: str, spec: str = "") -> str:
    """Where a table, or one partition of it, is."""
    part = f" PARTITION ({spec})" if spec else ""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}{part}").collect()
    begin = next(i for i, row in enumerate(rows) if row.col_name.startswith("# Detailed"))
    return next(row.data_type for row in rows[begin:] if row.col_name == "Location")


def _name(ref: Row) -> str:
    return f"{quoted(ref.schema_name)}.{quoted(ref.table_name)}"
