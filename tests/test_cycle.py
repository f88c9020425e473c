import pytest
from pyspark.sql import functions as F

from cloakwork.constants import DONE_TAG, FAILED_TAG, RUN_TAG, SUCCESS_TAG, TOKENIZED_TAG
from cloakwork.operators import rewrite as rw
from cloakwork.operators.runs import AUDIT_SCHEMA, current_outputs, latest_runs
from cloakwork.operators.tags import with_tags
from cloakwork.plans.cycle import RunConfig, run_cycle
from cloakwork.sources.crawl import crawl_database, crawl_parquet, to_catalog
from cloakwork.sources.footers import field_rows
from cloakwork.sources.payloads import read_payloads
from cloakwork.sources.seed import seed_contacts
from cloakwork.sources.tables import (
    CatalogTables,
    DataSourceTables,
    ParquetTables,
    PartitionedTables,
    read_parquet,
)

CONTACTS = ["email", "phone"]


def urn(name, platform="postgres"):
    return f"urn:li:dataset:(urn:li:dataPlatform:{platform},main.public.{name},PROD)"


def tagged(spark, catalog, rows):
    state = spark.createDataFrame(rows, "urn string, field_path string, tag string")
    return with_tags(catalog, state)


@pytest.fixture()
def store(spark, folder):
    source = f"{folder}/source/main/public"
    seed_contacts(spark).write.parquet(f"{source}/customers")
    spark.range(3).selectExpr("id", "id AS email").write.parquet(f"{source}/numbers")
    spark.range(3).selectExpr("id", "'x' AS city").write.parquet(f"{source}/cities")
    crawled = crawl_parquet(spark, source, platform="postgres", database="main", schema_name="public")
    tables = ParquetTables(f"{folder}/source", f"{folder}/target")
    return to_catalog(crawled), tables, f"{folder}/audit"


def statuses(result):
    return {r.urn: r for r in result.audit.collect()}


def current(spark, tables, audit, name):
    rows = current_outputs(spark.read.schema(AUDIT_SCHEMA).parquet(audit)).where(F.col("urn") == urn(name))
    return spark.read.parquet(rows.first().output)


def test_second_run_changes_nothing(spark, store):
    catalog, tables, audit = store
    config = RunConfig(platforms={"postgres": tables}, audit=audit)
    asked = tagged(spark, catalog, [(urn("customers"), "", RUN_TAG)])
    first = statuses(run_cycle(spark, asked, config))[urn("customers")]
    assert (first.status, first.columns, first.rows_updated, first.rows_skipped) == (
        "SUCCESS", CONTACTS, 100, 0,
    )
    assert first.message == "Tokenised columns email, phone; updated 100 rows, skipped 0."
    rows = current(spark, tables, audit, "customers")
    assert rows.exceptAll(rw.tokenize(seed_contacts(spark), CONTACTS)).isEmpty() and rows.count() == 100

    second = statuses(run_cycle(spark, asked, config))[urn("customers")]
    assert (second.status, second.rows_updated, second.output) == ("SUCCESS", 0, None)
    assert current(spark, tables, audit, "customers").count() == 100
    both = spark.read.schema(AUDIT_SCHEMA).parquet(audit)
    assert both.count() == 2 and latest_runs(both).first().run_id == second.run_id


def test_failures_are_per_dataset_and_keep_the_request(spark, store):
    catalog, tables, audit = store
    asked = tagged(
        spark, catalog,
        [(urn(n), "", RUN_TAG) for n in ("customers", "numbers", "cities")]
        + [(urn("customers"), "phone", "urn:li:tag:pii")],
    )
    other = asked.datasets.limit(1).withColumn("urn", F.lit(urn("x", "mysql")))
    solo = asked.datasets.limit(1).withColumn("urn", F.lit("urn:li:dataset:(urn:li:dataPlatform:postgres,solo,PROD)"))
    gone = asked.datasets.limit(1).withColumn("urn", F.lit(urn("gone")))
    extra = other.unionByName(solo).unionByName(gone).withColumn("global_tags", F.array(F.lit(RUN_TAG)))
    fields = asked.fields.unionByName(
        spark.createDataFrame(
            [(urn("x", "mysql"), 0, "t.email", "text", []), (urn("gone"), 0, "t.email", "text", [])],
            asked.fields.schema,
        )
    )
    catalog = type(asked)(asked.datasets.unionByName(extra), fields)
    result = run_cycle(spark, catalog, RunConfig(platforms={"postgres": tables}, audit=audit))
    got = statuses(result)
    assert got[urn("customers")].columns == ["phone"] and got[urn("customers")].status == "SUCCESS"
    assert got[urn("numbers")].message == "Only string columns can be tokenized: email is bigint"
    assert got[urn("cities")].message == "No PII columns detected; nothing to tokenise."
    assert got[urn("x", "mysql")].message == "Unsupported platform: mysql"
    assert got[urn("gone")].message == "AnalysisException: PATH_NOT_FOUND"
    assert {u: r.rows_updated for u, r in got.items() if r.status == "FAILED"} == {
        urn("numbers"): 0, urn("x", "mysql"): 0, urn("gone"): 0,
    }
    assert [r.reason for r in result.rejected.collect()] == ["parts"]

    after = {r.urn: set(r.global_tags) for r in result.catalog.datasets.collect()}
    assert after[urn("customers")] == {DONE_TAG, SUCCESS_TAG}
    assert after[urn("numbers")] == {RUN_TAG, FAILED_TAG}
    marked = result.catalog.fields.where(F.array_contains("tags", TOKENIZED_TAG)).collect()
    assert [(r.urn, r.field_path) for r in marked] == [(urn("customers"), "phone")]


def test_field_request_limits_the_columns(spark, store):
    catalog, tables, audit = store
    asked = tagged(spark, catalog, [(urn("customers"), "email", RUN_TAG)])
    result = run_cycle(spark, asked, RunConfig(platforms={"postgres": tables}, audit=audit))
    assert statuses(result)[urn("customers")].columns == ["email"]
    tags = {r.field_path: r.tags for r in result.catalog.fields.where(F.col("urn") == urn("customers")).collect()}
    assert tags == {"id": [], "email": [TOKENIZED_TAG], "phone": []}


def test_limited_runs_drain_a_table(spark, store):
    catalog, tables, audit = store
    config = RunConfig(platforms={"postgres": tables}, audit=audit, limit=40)
    asked = tagged(spark, catalog, [(urn("customers"), "", RUN_TAG)])
    seen = []
    for _ in range(4):
        row = statuses(run_cycle(spark, asked, config))[urn("customers")]
        seen.append((row.rows_updated, row.rows_remaining))
    assert seen == [(40, 60), (40, 20), (20, 0), (0, 0)]


def test_partitioned_table_keeps_its_layout(spark, folder):
    source = f"{folder}/s/main/public/customers"
    seed_contacts(spark).selectExpr("*", "id % 3 AS part").write.partitionBy("part").parquet(source)
    crawled = crawl_parquet(spark, f"{folder}/s/main/public", platform="postgres", database="main", schema_name="public")
    asked = tagged(spark, to_catalog(crawled), [(urn("customers"), "", RUN_TAG)])
    tables = ParquetTables(f"{folder}/s", f"{folder}/t", {"public.customers": ["part"]})
    row = statuses(run_cycle(spark, asked, RunConfig({"postgres": tables}, f"{folder}/audit")))[urn("customers")]
    rows = spark.read.parquet(row.output)
    assert rows.where("part = 1").count() == 34
    assert "PartitionFilters: [isnotnull(part" in rows.where("part = 1")._jdf.queryExecution().executedPlan().toString()


def test_tables_of_the_session_catalog(spark, folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    seed_contacts(spark).write.mode("overwrite").saveAsTable("shop.customers")
    crawled = crawl_database(spark, "shop", platform="spark", tables=["customers$"])
    assert [r.field_path for r in crawled.orderBy("pos").collect()] == ["id", "email", "phone"]
    catalog = to_catalog(crawled)
    name = catalog.datasets.first().urn
    asked = tagged(spark, catalog, [(name, "", RUN_TAG)])
    config = RunConfig({"spark": CatalogTables()}, f"{folder}/audit")
    row = statuses(run_cycle(spark, asked, config))[name]
    assert row.rows_updated == 100 and spark.table(row.output).where("email LIKE 'tok_%'").count() == 100
    assert statuses(run_cycle(spark, asked, config))[name].rows_updated == 0


def test_only_partitions_with_plaintext_are_replaced(spark, folder):
    root = f"{folder}/s/main/public/customers"
    rows = seed_contacts(spark).selectExpr("*", "IF(id % 4 = 3, NULL, id % 4) AS part", "'x' AS kind")
    clean = rw.tokenize(rows.where("part <=> 0"), CONTACTS)
    clean.unionByName(rows.where("NOT part <=> 0")).write.partitionBy("part", "kind").parquet(root)
    crawled = crawl_parquet(spark, f"{folder}/s/main/public", platform="postgres", database="main", schema_name="public")
    asked = tagged(spark, to_catalog(crawled), [(urn("customers"), "", RUN_TAG)])

    def files():
        paths = spark.read.parquet(root).select("part", F.col("_metadata.file_path").alias("p")).distinct().collect()
        return {part: {r.p for r in paths if r.part == part} for part in {r.part for r in paths}}

    for listed, changed in ((1000, 75), (1, 0)):
        before = files()
        tables = PartitionedTables(f"{folder}/s", {"public.customers": ["part", "kind"]}, listed)
        row = statuses(run_cycle(spark, asked, RunConfig({"postgres": tables}, f"{folder}/audit")))[urn("customers")]
        assert (row.status, row.rows_updated) == ("SUCCESS", changed)
        after = files()
        assert before[0] == after[0] and (before[None] != after[None]) == (changed > 0)
    got = spark.read.parquet(root)
    assert got.count() == 100 and rw.candidates(got, CONTACTS).isEmpty()
    assert got.where("part IS NULL").count() == 25


def test_partition_values_and_later_columns_survive(spark, folder):
    root = f"{folder}/s/main/public/customers"
    rows = seed_contacts(spark, 8).selectExpr("id", "email", "format_string('%02d', id % 4) AS hour")
    rows.write.partitionBy("hour").parquet(root)
    later = seed_contacts(spark, 4).selectExpr("id + 100 AS id", "email", "phone", "'00' AS hour")
    later.write.mode("append").partitionBy("hour").parquet(root)
    crawled = crawl_parquet(spark, f"{folder}/s/main/public", platform="postgres", database="main", schema_name="public")
    asked = tagged(spark, to_catalog(crawled), [(urn("customers"), "", RUN_TAG)])
    tables = PartitionedTables(f"{folder}/s", {"public.customers": ["hour"]}, wave=1)
    for limit, updated in ((0, 0), (None, 12)):
        config = RunConfig({"postgres": tables}, f"{folder}/audit{limit}", limit=limit)
        row = statuses(run_cycle(spark, asked, config))[urn("customers")]
        assert (row.status, row.rows_updated) == ("SUCCESS", updated)
    got = read_parquet(spark, root, ["hour"])
    assert sorted(got.columns) == ["email", "hour", "id", "phone"] and got.count() == 12
    assert {r.hour for r in got.select("hour").collect()} == {"00", "01", "02", "03"}
    assert rw.candidates(got, CONTACTS).isEmpty() and got.where("phone IS NOT NULL").count() == 4


def test_many_tables_are_profiled_together(spark, folder):
    for i in range(8):
        seed_contacts(spark, 5).selectExpr("id", "'no' AS email", "phone").write.parquet(f"{folder}/s/main/public/t{i}")
    crawled = crawl_parquet(spark, f"{folder}/s/main/public", platform="postgres", database="main", schema_name="public")
    asked = tagged(spark, to_catalog(crawled), [(urn(f"t{i}"), "", RUN_TAG) for i in range(8)])
    config = RunConfig({"postgres": ParquetTables(f"{folder}/s", f"{folder}/t")}, f"{folder}/audit", check_values=True)
    rows = statuses(run_cycle(spark, asked, config))
    assert {(r.status, tuple(r.columns)) for r in rows.values()} == {("SUCCESS", ("phone",))} and len(rows) == 8


def test_an_unreadable_table_is_left_out_of_the_crawl(spark, folder):
    seed_contacts(spark, 3).write.parquet(f"{folder}/s/good")
    with open(f"{folder}/s/bad.parquet", "w") as file:
        file.write("not parquet")
    crawled = crawl_parquet(spark, f"{folder}/s")
    assert {(r.table_name, r.problem) for r in crawled.collect()} == {("good", None), ("bad", "ArrowInvalid")}
    catalog = to_catalog(crawled)
    assert [r.name for r in catalog.datasets.collect()] == ["default.default.good"] and catalog.fields.count() == 3


def test_many_partitions_are_all_replaced(spark, folder):
    root = f"{folder}/s/main/public/customers"
    seed_contacts(spark).selectExpr("*", "id % 5 AS part").write.partitionBy("part").parquet(root)
    crawled = crawl_parquet(spark, f"{folder}/s/main/public", platform="postgres", database="main", schema_name="public")
    asked = tagged(spark, to_catalog(crawled), [(urn("customers"), "", RUN_TAG)])
    tables = PartitionedTables(f"{folder}/s", {"public.customers": ["part"]}, wave=2)
    row = statuses(run_cycle(spark, asked, RunConfig({"postgres": tables}, f"{folder}/audit")))[urn("customers")]
    got = spark.read.parquet(root)
    assert row.rows_updated == got.count() == 100 and rw.candidates(got, CONTACTS).isEmpty()


def test_generic_data_source_gets_the_changed_rows(spark, folder):
    def place(name):
        return f"{folder}/public.{name}"

    rows = rw.tokenize(seed_contacts(spark, 5), CONTACTS, limit=2).withColumn("city", F.lit("c"))
    rows.write.option("header", True).csv("file://" + place("customers"))
    crawled = spark.createDataFrame(
        [("db", "main", f"{folder}/public", "customers", "", i, c, "string") for i, c in enumerate(["id", *CONTACTS])],
        "platform string, database string, schema_name string, table_name string, location string, "
        "pos int, field_path string, native_data_type string",
    )
    catalog = to_catalog(crawled)
    name = catalog.datasets.first().urn
    tables = DataSourceTables("csv", {"header": "true", "inferSchema": "true"}, table_option="path")
    asked = tagged(spark, catalog, [(name, "", RUN_TAG)])
    result = statuses(run_cycle(spark, asked, RunConfig({"db": tables}, f"{folder}/audit")))[name]
    assert (result.status, result.rows_updated) == ("SUCCESS", 3)
    staged = spark.read.option("header", True).csv(result.output)
    assert staged.columns == ["id", *CONTACTS] and staged.count() == 3
    assert {r.id for r in staged.collect()} == {"3", "4", "5"}


def test_values_are_checked_on_request(spark, folder):
    source = f"{folder}/source/main/public"
    rows = seed_contacts(spark).selectExpr(
        "id", "email", "'n/a' AS backup_email", "'n/a' AS contact_email", "CAST(NULL AS string) AS phone"
    )
    rows.write.parquet(f"{source}/customers")
    crawled = crawl_parquet(spark, source, platform="postgres", database="main", schema_name="public")
    asked = tagged(spark, to_catalog(crawled), [(urn("customers"), "", RUN_TAG)])
    other = asked.datasets.withColumn("urn", F.lit(urn("gone")))
    gone = asked.fields.withColumn("urn", F.lit(urn("gone")))
    asked = type(asked)(asked.datasets.unionByName(other), asked.fields.unionByName(gone))
    for check, columns in (
        (True, ["contact_email", "email"]),
        (False, ["backup_email", "contact_email", "email", "phone"]),
    ):
        platforms = {"postgres": ParquetTables(f"{folder}/source", f"{folder}/target")}
        config = RunConfig(platforms, f"{folder}/audit-{check}", check_values=check)
        got = statuses(run_cycle(spark, asked, config))
        assert got[urn("customers")].columns == columns
        assert got[urn("gone")].status == "FAILED" and len(got[urn("gone")].columns) == 4


def test_unknown_mode_fails_the_run(spark, store):
    catalog, tables, audit = store
    asked = tagged(spark, catalog, [(urn("customers"), "", RUN_TAG)])
    result = run_cycle(spark, asked, RunConfig({"postgres": tables}, audit, mode="vault"))
    assert statuses(result)[urn("customers")].message == "Token mode 'vault' is not registered"


def test_cycle_without_requests(spark, store):
    catalog, tables, audit = store
    result = run_cycle(spark, catalog, RunConfig({"postgres": tables}, audit))
    assert result.audit.isEmpty()


def test_nested_columns_get_dotted_paths(spark):
    schema = spark.createDataFrame([], "id int, who struct<name:string, home:struct<zip:string>>").schema
    assert [p for p, _ in field_rows(schema)] == ["id", "who", "who.name", "who.home", "who.home.zip"]


def test_seed_rows(spark):
    rows = seed_contacts(spark).orderBy("id").collect()
    assert len(rows) == 100
    assert tuple(rows[0]) == (1, "user1@example.com", "+1-555-0001")
    assert tuple(rows[-1]) == (100, "user100@example.com", "+1-555-0100")


def test_payload_files_stay_text(spark, folder):
    with open(f"{folder}/c.json", "w") as out:
        out.write('{"urn":"u","payload":{"name":"n","tags":["a",{"b":1}]}}\n')
    row = read_payloads(spark, folder).first()
    assert (row.urn, row.payload) == ("u", '{"name":"n","tags":["a",{"b":1}]}')
