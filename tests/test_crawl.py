import datetime
import decimal
import os
import pathlib
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cloakwork.sources import footers
from cloakwork.sources.crawl import crawl_parquet
from cloakwork.sources.footers import CONFLICT, field_rows, file_schemas, table_files, table_schemas
from cloakwork.sources.tables import read_parquet


def columns(crawled, table):
    rows = crawled.where(F.col("table_name") == table).orderBy("pos").collect()
    return [(r.field_path, r.native_data_type) for r in rows]


def by_spark(spark, location):
    return field_rows(read_parquet(spark, location).schema)


ODD_VALUES = {
    "uint8": pa.array([1], pa.uint8()), "uint32": pa.array([1], pa.uint32()), "uint64": pa.array([1], pa.uint64()),
    "small": pa.array([decimal.Decimal("1.5")], pa.decimal128(5, 2)), "large_string": pa.array(["x"], pa.large_string()),
    "day": pa.array([datetime.date(2020, 1, 1)]), "local": pa.array([0], pa.timestamp("us")), "fixed": pa.array([b"ab"], pa.binary(2)),
    "utc": pa.array([0], pa.timestamp("ms", tz="UTC")), "dictionary": pa.array(["x"]).dictionary_encode(),
    "list": pa.array([[1.5]], pa.list_(pa.float32())), "map": pa.array([[("a", 1)]], pa.map_(pa.string(), pa.int64())),
    "struct": pa.array([{"a": 1, "b": {"c": [True]}}]), "half": pa.array([1.0], pa.float32()).cast(pa.float16()),
    "fixed_list": pa.array([[1.0, 2.0]], pa.list_(pa.float32(), 2)), "span": pa.array([5], pa.duration("us")),
}


def test_types_of_files_of_other_writers(spark, folder):
    os.makedirs(f"{folder}/s")
    for name, values in ODD_VALUES.items():
        pq.write_table(pa.table({"v": values, "id": [1]}), f"{folder}/s/{name}.parquet")
    found = crawl_parquet(spark, f"{folder}/s")
    problems = {r.table_name: r.problem for r in found.collect()}
    for name in ODD_VALUES:
        try:
            wanted = by_spark(spark, f"{folder}/s/{name}.parquet")
        except Exception:  # noqa: BLE001 - what Spark cannot read is a problem here too
            assert problems[name], name
        else:
            assert columns(found, name) == wanted, name
    assert set(problems) == set(ODD_VALUES)


def test_schemas_partitions_and_nested_fields_merge_as_in_spark(spark, folder):
    root = f"{folder}/s"
    rows = spark.range(4).selectExpr("id", "struct(id AS a, 'x' AS b) AS s", "format_string('%02d', id) AS hour", "'k' AS `day of`")
    rows.write.partitionBy("hour", "day of").parquet(f"{root}/t")
    later = rows.selectExpr("'z' AS more", "struct('y' AS c, id AS a) AS s", "id", "'00' AS hour", "'a%b' AS `day of`")
    later.write.mode("append").partitionBy("hour", "day of").parquet(f"{root}/t")
    rows.drop("hour").write.parquet(f"{root}/flat/inner")  # a folder that is no partition
    rows.write.parquet(f"{root}/plain")
    pathlib.Path(f"{root}/_SUCCESS").touch()
    os.makedirs(f"{root}/empty")
    found = crawl_parquet(spark, root)
    for table in ("t", "plain"):
        assert columns(found, table) == by_spark(spark, f"{root}/{table}")
    assert columns(found, "t")[-2:] == [("hour", "string"), ("day of", "string")]
    assert {r.table_name for r in found.where("problem IS NULL").collect()} == {"t", "plain"}
    assert [r.table_name for r in found.where("problem IS NOT NULL").collect()] == ["flat"]  # Spark finds no schema there
    assert crawl_parquet(spark, root, tables=["pl"]).select("table_name").distinct().collect() == [("plain",)]
    assert crawl_parquet(spark, f"{root}/empty").isEmpty()


def test_types_that_do_not_merge_are_a_problem(spark, folder):
    spark.range(1).selectExpr("id AS v").write.parquet(f"{folder}/s/t")
    spark.range(1).selectExpr("'x' AS v").write.mode("append").parquet(f"{folder}/s/t")
    found = crawl_parquet(spark, f"{folder}/s").collect()
    assert [(r.table_name, r.field_path, r.problem) for r in found] == [("t", None, CONFLICT)]


def test_known_footers_are_not_opened_again(spark, folder):
    root, cache = f"{folder}/s", f"{folder}/cache"
    spark.range(40).selectExpr("id", "'x' AS name").repartition(20).write.parquet(f"{root}/t")
    first = sorted(crawl_parquet(spark, root, cache=cache).collect())
    for file in pathlib.Path(f"{root}/t").glob("*.parquet"):  # no parquet any more, but name, size and time are
        info = file.stat()
        file.write_bytes(b"x" * info.st_size)
        os.utime(file, ns=(info.st_atime_ns, info.st_mtime_ns))
    assert sorted(crawl_parquet(spark, root, cache=cache).collect()) == first
    assert [r.problem for r in crawl_parquet(spark, root).collect()] == ["ArrowInvalid"]
    kept = sorted(os.listdir(cache))
    spark.range(1).selectExpr("id", "true AS late").write.mode("append").parquet(f"{root}/t")
    assert {c for c, _ in columns(crawl_parquet(spark, root, cache=cache), "t")} == {"id", "name", "late"}
    assert len(spark.read.parquet(cache).collect()) == 21 and len(os.listdir(cache)) > len(kept)
    shutil.copy(next(pathlib.Path(f"{root}/t").glob("*.parquet")), f"{root}/t/copy.parquet")
    os.truncate(f"{root}/t/copy.parquet", 3)
    for _ in range(2):  # an unreadable file is looked at each time
        assert [r.problem for r in crawl_parquet(spark, root, cache=cache).collect()] == ["ArrowInvalid"]
    assert spark.read.parquet(cache).where("problem IS NOT NULL").isEmpty()


def test_a_table_of_many_files_is_one_row_per_schema(spark, folder):
    os.makedirs(f"{folder}/s/t")
    pq.write_table(pa.table({"id": [1]}), f"{folder}/one.parquet")
    for i in range(2_000):
        os.link(f"{folder}/one.parquet", f"{folder}/s/t/{i}.parquet")
    files = table_files(spark, f"{folder}/s")
    assert files.count() == 2_000
    assert table_schemas(files.join(file_schemas(files), ["path", "size", "modified"])).count() == 1


@pytest.mark.parametrize("location, wanted", [
    ("file:/a b/c%20d", ("file", "", "/a b/c%20d")), ("file:///x", ("file", "", "/x")),
    ("s3a://bucket/k/v=1", ("s3a", "bucket", "bucket/k/v=1")), ("hdfs://host:8020/x", ("hdfs", "host:8020", "/x")),
])
def test_locations(location, wanted):
    assert footers._taken_apart(location) == wanted


def test_file_systems_that_workers_do_not_know(spark, folder, monkeypatch):
    rows = spark.range(2).selectExpr("id", "'x' AS name")
    rows.write.parquet(f"{folder}/s/t")
    listed = sorted(crawl_parquet(spark, f"{folder}/s").collect())
    monkeypatch.setattr("cloakwork.sources.crawl.can_list", lambda *_: False)
    assert sorted(crawl_parquet(spark, f"{folder}/s").collect()) == listed
