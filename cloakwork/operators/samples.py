"""Samples of columns that can be merged: the ``k`` distinct values with the smallest hashes.

A profile of a large table needs no second look at what was looked at before. A column's sample says
which validators its sampled values match and how often each value occurs, and one more row, without a
hash, counts all rows. Values are ordered by their MD5, so the sample is the same however the rows are
split: the sample of two parts together is the smallest ``k`` of their samples, and its counts are exact,
because a value among the smallest of the whole is among the smallest of every part that has it.
Distinct values count alike, so a value that fills a third of the table takes one place.

Values themselves are not kept, only hashes and matches, so that no plaintext is left behind in a store.
Hashes of guessable values can be guessed; keep stores where the tables may be read. Other rules need a new
sample. ``k`` is a bound of a sample, not of the exact profile, which stays
:func:`~cloakwork.operators.detect.profile_table`: a column with more than ``k`` values can hold a match that
its sample has not.

NULLs count as rows and are no values. Tables without rows have the row of the total only.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..functions.patterns import matches
from ..session import local_rows, stored
from .detect import Rules, _hit, sample_text

#: Values of a column's sample.
SAMPLE = 1000


def sample_schema(rules: Rules) -> str:
    hits = "".join(f", `{_hit(name)}` boolean" for name in rules.validators)
    return f"column_name string, hash string, n bigint{hits}"


def _hash_limit(distinct: int, k: int) -> str | None:
    """A hash below which ``k`` of so many values lie, but for bad luck; None if all are needed."""
    wanted = 1.2 * (k + 4 * k**0.5 + 16)  # four deviations of the values, and of their estimated number
    return f"{int(wanted / distinct * 2**60):015x}" if distinct > 2 * wanted else None


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.asc_nulls_first("hash")))
    return rows.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def _counted(df: DataFrame, texts: dict[str, Column], limits: dict[str, str | None]) -> DataFrame:
    """Distinct values with a hash within their column's limit, and how often each occurs."""
    entries = []
    for name, text in texts.items():
        value = F.struct(F.lit(name).alias("column_name"), F.md5(text).alias("hash"), text.alias("value"))
        limit = limits.get(name)
        entries.append(F.when(text.isNotNull() if limit is None else F.md5(text) <= limit, value))
    values = df.select(F.explode(F.array_compact(F.array(*entries))).alias("one")).select("one.*")
    return values.groupBy("column_name", "hash", "value").agg(F.count("*").alias("n"))


def column_samples(
    df: DataFrame, columns: list[str] | None = None, rules: Rules | None = None, *, k: int = SAMPLE, known: DataFrame | None = None
) -> DataFrame:
    """Sample of columns of ``df``, by default its string columns: ``column_name, hash, n, hit_*``.

    A first scan estimates how many values a column has and so which hashes can be among the smallest;
    only values with these are gathered by a second one. A column that has fewer of them than expected is read
    again without that limit, so results do not hang on the estimate. ``known`` is the sample of other rows
    of the table: where it is full, its largest hash is the limit, as no larger one can enter the merged sample.
    The result is written; the driver sees a row per column.
    """
    rules = rules or Rules()
    spark = df.sparkSession
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not columns:
        return local_rows(spark, [], sample_schema(rules))
    texts = {c: sample_text(df, c) for c in columns}
    counts = df.agg(F.count("*"), *[F.approx_count_distinct(quoted(c)) for c in columns]).first()
    limits = {c: _hash_limit(n, k) for c, n in zip(columns, counts[1:])}
    full: dict[str, str] = {}
    if known is not None:
        ends = known.where("hash IS NOT NULL").groupBy("column_name").agg(F.count("*").alias("n"), F.max("hash").alias("last"))
        full = {row.column_name: row["last"] for row in ends.collect() if row.n >= k}
        limits |= {c: min(last, limits[c] or last) for c, last in full.items() if c in limits}
    hits = [F.coalesce(matches(F.col("value"), regex), F.lit(False)).alias(_hit(v)) for v, regex in rules.validators.items()]

    def sample(names: list[str], within: dict[str, str | None]) -> DataFrame:
        rows = _smallest(_counted(df, {c: texts[c] for c in names}, within), k)
        return stored(rows.select("column_name", "hash", "n", *hits), "samples")

    found = sample(columns, limits)
    guessed = [c for c in columns if limits[c] and limits[c] != full.get(c)]
    if guessed:
        sizes = dict(found.groupBy("column_name").count().collect())
        short = [c for c in guessed if sizes.get(c, 0) < k]
        if short:
            rest = sample(short, full)
            found = found.where(~F.col("column_name").isin(short)).unionByName(rest)
    totals = [(c, None, counts[0], *[False] * len(hits)) for c in columns]
    return found.unionByName(local_rows(spark, totals, sample_schema(rules)))


def merge_samples(first: DataFrame, *others: DataFrame, k: int = SAMPLE) -> DataFrame:
    """Sample of all rows from samples of parts, each of which had ``k`` or more."""
    rows = first
    for other in others:
        rows = rows.unionByName(other)
    hits = [F.bool_or(quoted(c)).alias(c) for c in first.columns if c not in ("column_name", "hash", "n")]
    merged = rows.groupBy("column_name", "hash").agg(F.sum("n").alias("n"), *hits)
    return _smallest(merged, k + 1)  # and the row of the total


def sampled_profile(sample: DataFrame) -> DataFrame:
    """``column_name, n, hit_*`` as :func:`~cloakwork.operators.detect.profile_table` gives, from a sample."""
    hits = [c for c in sample.columns if c not in ("column_name", "hash", "n")]
    return sample.groupBy("column_name").agg(
        F.max(F.when(F.col("hash").isNull(), F.col("n"))).alias("n"),
        *[F.coalesce(F.bool_or(quoted(c)), F.lit(False)).alias(c) for c in hits],
    )


class SampleStore:
    """Samples of growing tables, one folder for each name; a refresh reads only files that are new.

    A version is a folder named by the time up to which files were read, and counts once it is complete; a
    run cut short leaves the last one as it was. Files are told by their time of change. Those younger than
    ``quiet`` seconds wait for the next refresh, so that a file which appears late is not passed over.
    Values of files that were replaced or removed since stay in the sample: ``forget`` begins anew.
    One process at a time may refresh a name.
    """

    def __init__(self, spark: SparkSession, folder: str, *, rules: Rules | None = None, k: int = SAMPLE, quiet: float = 60.0):
        self.spark, self.folder, self.rules, self.k, self.quiet = spark, folder.rstrip("/"), rules or Rules(), k, quiet

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        place, system = self._place(f"{self.folder}/{name}")
        if not system.exists(place):
            return []
        found = [status.getPath().getName() for status in system.listStatus(place)]
        whole = [v for v in found if v.isdigit() and system.exists(self._place(f"{self.folder}/{name}/{v}/_SUCCESS")[0])]
        return sorted(map(int, whole))

    def _read(self, name: str, version: int) -> DataFrame:
        return self.spark.read.schema(sample_schema(self.rules)).parquet(f"{self.folder}/{name}/{version:020d}")

    def sample(self, name: str) -> DataFrame | None:
        """The sample as it was last refreshed."""
        versions = self._versions(name)
        return self._read(name, versions[-1]) if versions else None

    def refresh(self, name: str, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Takes in the files of ``df``, a table read from files, that came since the last refresh."""
        versions = self._versions(name)
        until = datetime.now(UTC) - timedelta(seconds=self.quiet)
        version = int(until.timestamp() * 1_000_000)
        if versions and version <= versions[-1]:
            return self._read(name, versions[-1])
        changed = F.col("_metadata.file_modification_time")
        rows, known = df.where(changed <= F.lit(until)), None
        if versions:
            known = self._read(name, versions[-1])
            rows = rows.where(changed > F.timestamp_micros(F.lit(versions[-1])))
        sample = column_samples(rows, columns, self.rules, k=self.k, known=known)
        if known is not None:
            sample = merge_samples(known, sample, k=self.k)
        sample.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}/{version:020d}")
        for old in versions[:-1]:  # the last one may still be read
            place, system = self._place(f"{self.folder}/{name}/{old:020d}")
            system.delete(place, True)
        return self._read(name, version)

    def forget(self, name: str) -> None:
        place, system = self._place(f"{self.folder}/{name}")
        system.delete(place, True)
