"""Tables that keep their name: files replaced one by one, locations swapped, conflicts."""

import hashlib
import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from cloakwork.constants import RUN_TAG
from cloakwork.operators import rewrite as rw
from cloakwork.operators.tags import with_tags
from cloakwork.plans.cycle import RunConfig, run_cycle
from cloakwork.sources import published
from cloakwork.sources.crawl import crawl_database, crawl_parquet, to_catalog
from cloakwork.sources.published import FileTables, PublishedTables, remove_retired
from cloakwork.sources.seed import seed_contacts
from cloakwork.sources.tables import read_parquet

CONTACTS = ["email", "phone"]


def urn(name, schema="public", platform="postgres", database="main"):
    return f"urn:li:dataset:(urn:li:dataPlatform:{platform},{database}.{schema}.{name},PROD)"


def contacts(spark, start, n=100, done=False):
    rows = seed_contacts(spark, n).withColumn("id", F.col("id") + start)
    return rw.tokenize(rows, CONTACTS) if done else rows


def asked(spark, crawled, *names):
    state = spark.createDataFrame([(n, "", RUN_TAG) for n in names], "urn string, field_path string, tag string")
    return with_tags(to_catalog(crawled), state)


def digests(folder):
    files = pathlib.Path(folder).rglob("*.parquet")
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in files if "_rewrite" not in str(p)}


def run(spark, folder, tables, name="customers"):
    crawled = crawl_parquet(spark, f"{folder}/main/public", platform="postgres", database="main", schema_name="public")
    config = RunConfig({"postgres": tables}, f"{folder}-audit/{uuid.uuid4().hex}")
    return run_cycle(spark, asked(spark, crawled, urn(name)), config).audit.first()


def test_only_files_with_plaintext_change(spark, folder):
    place = f"{folder}/main/public/customers"
    for i in range(6):
        contacts(spark, 100 * i, done=i % 3 != 0).coalesce(1).write.mode("append").parquet(place)
    want = rw.tokenize(spark.read.parquet(place), CONTACTS).collect()
    before = digests(place)
    first = run(spark, folder, FileTables(folder, wave=1))
    assert (first.status, first.rows_updated) == ("SUCCESS", 200)
    after = digests(place)
    assert before.keys() == after.keys() and sum(before[f] != after[f] for f in before) == 2
    assert sorted(spark.read.parquet(place).collect()) == sorted(want)
    assert not pathlib.Path(place, "_rewrite").exists()
    second = run(spark, folder, FileTables(folder))
    assert (second.status, second.rows_updated) == ("SUCCESS", 0) and digests(place) == after


def test_files_without_rows_are_no_arrivals(spark, folder):
    place = f"{folder}/main/public/customers"
    contacts(spark, 0).coalesce(1).write.parquet(place)
    contacts(spark, 100).limit(0).coalesce(1).write.mode("append").parquet(place)
    want = rw.tokenize(spark.read.parquet(place), CONTACTS).collect()
    before = digests(place)
    row = run(spark, folder, FileTables(folder))
    after = digests(place)
    assert (row.status, row.rows_updated) == ("SUCCESS", 100)
    assert len(before) == 2 and before.keys() == after.keys() and sum(before[f] != after[f] for f in before) == 1
    assert sorted(spark.read.parquet(place).collect()) == sorted(want)


def test_partitions_with_odd_values_and_evolved_columns(spark, folder):
    place = f"{folder}/main/public/customers"
    hours = F.element_at(F.array(*map(F.lit, ["00", "a b:c", "10%", "x*[y]", "é"])), (F.col("id") % 6 + 1).cast("int"))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    old = contacts(spark, 0).withColumn("hour", hours)
    old.repartition(2).write.partitionBy("hour").parquet(place)
    new = contacts(spark, 1000, done=True).withColumns({"hour": F.lit("00"), "city": F.lit("x")})
    new.coalesce(1).write.mode("append").partitionBy("hour").parquet(place)
    spark.conf.unset("spark.sql.ansi.enabled")
    columns = ["id", "email", "phone", "city", "hour"]
    want = rw.tokenize(read_parquet(spark, place), CONTACTS).select(*columns).collect()
    row = run(spark, folder, FileTables(folder, {"public.customers": ["hour"]}))
    assert (row.status, row.rows_updated) == ("SUCCESS", 100)
    got = read_parquet(spark, place).select(*columns).collect()
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.hour for r in got} == {"00", "a b:c", "10%", "x*[y]", "é", None}


def test_nested_columns_and_large_files_are_copied_whole(spark, folder):
    place = f"{folder}/main/public/customers"
    rows = contacts(spark, 0, 5000).withColumns(
        {"m": F.create_map(F.lit("k"), "email"), "s": F.struct("id", F.lit(None).cast("string").alias("n")), "a.b": F.lit(1.5)}
    )
    rows.coalesce(1).write.option("parquet.block.size", 4096).parquet(place)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        row = run(spark, folder, FileTables(folder))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (row.status, row.rows_updated) == ("SUCCESS", 5000)
    got = spark.read.parquet(place)
    want = rw.tokenize(rows, CONTACTS)
    text = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in want.columns]))]
    assert len(digests(place)) == 1 and got.select(text).exceptAll(want.select(text)).isEmpty()


def change_once(monkeypatch, action):
    """Runs ``action`` once the new version has been written."""
    write, done = published._write_checked, []

    def changed(*args):
        back = write(*args)
        if not done:
            done.append(True)
            action()
        return back

    monkeypatch.setattr(published, "_write_checked", changed)


def test_rows_that_arrive_during_a_run_are_not_lost(spark, folder, monkeypatch):
    place = f"{folder}/main/public/customers"
    contacts(spark, 0).coalesce(1).write.parquet(place)
    change_once(monkeypatch, lambda: contacts(spark, 500, 7).coalesce(1).write.mode("append").parquet(place))
    row = run(spark, folder, FileTables(folder))
    assert (row.status, row.rows_updated) == ("SUCCESS", 107)
    got = spark.read.parquet(place)
    assert got.count() == 107 and rw.candidates(got, CONTACTS).isEmpty()


def test_a_changed_file_fails_the_run(spark, folder, monkeypatch):
    place = f"{folder}/main/public/customers"
    contacts(spark, 0).coalesce(1).write.parquet(place)
    (old,) = pathlib.Path(place).glob("*.parquet")
    other = f"{folder}/other"
    contacts(spark, 50, 3).coalesce(1).write.parquet(other)
    (new,) = pathlib.Path(other).glob("*.parquet")

    def replace():
        old.write_bytes(new.read_bytes())
        old.with_name(f".{old.name}.crc").unlink()

    change_once(monkeypatch, replace)
    row = run(spark, folder, FileTables(folder))
    assert (row.status, row.message) == ("FAILED", "A file of the table changed during the run")
    assert spark.read.parquet(place).count() == 3
    assert run(spark, folder, FileTables(folder)).rows_updated == 3


def test_a_wrong_copy_is_not_published(spark, folder, monkeypatch):
    place = f"{folder}/main/public/customers"
    contacts(spark, 0).coalesce(1).write.parquet(place)
    before = digests(place)
    digest, seen = published._digest, []

    def other(df, columns):
        seen.append(True)
        return digest(df, columns)[:1] + [F.lit(len(seen)).cast("decimal(30,0)").alias("hashes")] if len(seen) > 1 else digest(df, columns)

    monkeypatch.setattr(published, "_digest", other)
    row = run(spark, folder, FileTables(folder))
    assert (row.status, row.message) == ("FAILED", "The new version does not read back as it was written")
    assert digests(place) == before


def test_a_limit_replaces_files_too(spark, folder):
    place = f"{folder}/main/public/customers"
    contacts(spark, 0).repartitionByRange(4, "id").write.parquet(place)
    crawled = crawl_parquet(spark, f"{folder}/main/public", platform="postgres", database="main", schema_name="public")
    config = RunConfig({"postgres": FileTables(folder)}, f"{folder}-audit", limit=30)
    left = []
    for _ in range(4):
        left.append(run_cycle(spark, asked(spark, crawled, urn("customers")), config).audit.first().rows_remaining)
    assert left == [70, 40, 10, 0]


# --- tables of the catalog -----------------------------------------------------------------------


@pytest.fixture()
def database(spark):
    name = f"db_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def run_published(spark, folder, database, *names):
    crawled = crawl_database(spark, database, platform="postgres")
    urns = [urn(n, database, database="spark_catalog") for n in names]
    tables = PublishedTables(f"{folder}/retired", wave=2)
    config = RunConfig({"postgres": tables}, f"{folder}/audit-{uuid.uuid4().hex}")
    return {r.urn.split(".")[2].split(",")[0]: r for r in run_cycle(spark, asked(spark, crawled, *urns), config).audit.collect()}


def test_a_table_points_to_its_new_version(spark, folder, database):
    name = f"{database}.customers"
    contacts(spark, 0).write.saveAsTable(name)
    before = spark.table(name)
    want = sorted(rw.tokenize(before, CONTACTS).collect())
    old = published._location(spark, name)
    row = run_published(spark, folder, database, "customers")["customers"]
    assert (row.status, row.rows_updated, row.output) == ("SUCCESS", 100, f"`{database}`.`customers`")
    assert sorted(spark.table(name).collect()) == want
    assert published._location(spark, name) != old and before.count() == 100  # old readers go on
    assert remove_retired(spark, f"{folder}/retired", 3600) == 0
    assert remove_retired(spark, f"{folder}/retired", -1) == 1
    assert not pathlib.Path(old.removeprefix("file:")).exists() and sorted(spark.table(name).collect()) == want
    assert run_published(spark, folder, database, "customers")["customers"].rows_updated == 0


def test_only_partitions_with_plaintext_move(spark, folder, database):
    name = f"{database}.customers"
    region = F.element_at(F.array(*map(F.lit, ["eu/1", "it's", "us", "x y"])), (F.col("id") % 5 + 1).cast("int"))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    plain = contacts(spark, 0).withColumns({"region": region, "day": (F.col("id") % 2).cast("int")})
    done = rw.tokenize(plain, CONTACTS).where("region = 'us'")
    plain.where("region <> 'us' OR region IS NULL").unionByName(done).write.partitionBy("region", "day").saveAsTable(name)
    spark.conf.unset("spark.sql.ansi.enabled")
    want = sorted(rw.tokenize(spark.table(name), CONTACTS).collect(), key=str)
    kept = published._location(spark, name, "region = 'us', day = 1")
    moved = published._location(spark, name, "region = 'x y', day = 0")
    row = run_published(spark, folder, database, "customers")["customers"]
    assert (row.status, row.rows_updated) == ("SUCCESS", 80)
    assert sorted(spark.table(name).collect(), key=str) == want
    assert published._location(spark, name, "region = 'us', day = 1") == kept
    assert published._location(spark, name, "region = 'x y', day = 0") != moved
    assert remove_retired(spark, f"{folder}/retired", -1) == 8
    assert sorted(spark.table(name).collect(), key=str) == want


def test_a_swap_needs_an_unchanged_table(spark, folder, database, monkeypatch):
    name = f"{database}.customers"
    contacts(spark, 0).write.saveAsTable(name)
    old = published._location(spark, name)
    change_once(monkeypatch, lambda: contacts(spark, 500, 7).coalesce(1).write.mode("append").parquet(old))
    row = run_published(spark, folder, database, "customers")["customers"]
    assert (row.status, row.message) == ("FAILED", "Files arrived in the table during the run")
    assert published._location(spark, name) == old
    assert remove_retired(spark, f"{folder}/retired", -1) == 0  # still in use
    spark.catalog.refreshTable(name)
    assert run_published(spark, folder, database, "customers")["customers"].rows_updated == 107
