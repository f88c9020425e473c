"""The registered queries: ``name -> function(spark, sf_dir)``."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cloakwork.constants import RUN_TAG, STATUS_PROPERTY
from cloakwork.functions import (
    TokenMode,
    csv,
    generate_token,
    is_token,
    iso_timestamp,
    leaf_column,
    parse_status,
    register_mode,
    register_sql_functions,
    success_message,
    table_expression,
    tokenize_if_needed,
    tokenize_many,
)
from cloakwork.functions.names import name_schema, name_table
from cloakwork.operators import catalog as cat
from cloakwork.operators import detect as det
from cloakwork.operators import rewrite as rw
from cloakwork.operators import runs, tags
from cloakwork.operators.many import names_by_patterns
from cloakwork.operators.samples import column_samples, merge_samples
from cloakwork.plans.cycle import RunConfig, run_cycle
from cloakwork.session import local_rows, stored, workspace
from cloakwork.sources.crawl import crawl_database, crawl_parquet, to_catalog
from cloakwork.sources.seed import contacts
from cloakwork.sources.published import FileTables, PublishedTables
from cloakwork.sources.tables import ParquetTables, read_parquet
from cloakwork.streaming.requests import RequestLoop
from cloakwork.streaming.rows import tokenize_stream, write_files

from .fixtures import view

CONTACTS = ["email", "phone"]
CUSTOM_RULES = {"name_patterns": ["city", "addr"]}
SEARCH = ("public.t13", "databricks")
ALLOW = {"schema_name": ["^public$"], "table_name": ["^t1"]}
PAGE_AFTER = "urn:li:dataset:(urn:li:dataPlatform:mysql,"
REPORT_PASSES = 4
LIMIT = 100
LARGE_LIMIT = 12_000
CUSTOM_VALIDATORS = {
    "email": r"(?P<who>u)(?P<number>\d+)@(?!test)[^\W\d_]+\.com\b",
    "phone": r"[^\s@]{3}-a-|\+1-(?P<area>\d)(?P=area)(?P=area)-\d{4}$",
    "mobile": r"(?x) [+] \d {1,3} - # country",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tag_array(tag: str) -> Column:
    return F.when(F.col(tag).isNotNull(), F.array(tag)).otherwise(cat.no_tags())


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_catalog").withColumn("global_tags", _tag_array("global_tag"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_fields").withColumn("tags", _tag_array("tag"))


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = view(spark, sf_dir, "fx_editable").withColumns(
        {"tags": _tag_array("tag"), "pos": F.lit(0)}
    )
    return cat.effective_fields(_fields(spark, sf_dir), edits, key="k")


def _stored_catalog(spark: SparkSession, sf_dir: str) -> cat.Catalog:
    return cat.Catalog(_datasets(spark, sf_dir), stored(_effective(spark, sf_dir), "fields"))


def _written(catalog: cat.Catalog) -> cat.Catalog:
    """Catalog tables as a catalog keeps them: detection reads them several times."""
    return cat.Catalog(stored(catalog.datasets, "datasets"), stored(catalog.fields, "fields"))


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_scope").select("k", "name")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.profile_samples(view(spark, sf_dir, "fx_samples"), keys=["col"])


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_customers")


# --- tokenization ---------------------------------------------------------------------------------


def tokenize_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.tokenize(_customers(spark, sf_dir), CONTACTS)


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return rw.tokenize(docs, ["text"])


def tokenize_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.tokenize(_customers(spark, sf_dir), CONTACTS, limit=LIMIT)


def tokenize_limited_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit far beyond what one task sorts."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("email"))
    return rw.tokenize(rows, ["email"], limit=LARGE_LIMIT)


def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.candidates(_customers(spark, sf_dir), CONTACTS)


def token_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return view(spark, sf_dir, "fx_edge").select(
        "id",
        is_token(v).alias("is_token"),
        generate_token(v).alias("token"),
        tokenize_if_needed(v).alias("if_needed"),
    )


def tokenize_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(tokenize_many(lines), ",").alias("tokens")
    )


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.run_metrics(_customers(spark, sf_dir), CONTACTS)


def run_metrics_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _customers(spark, sf_dir)
    within, _ = rw.first_candidates(rw.candidates(customers, CONTACTS), LIMIT)
    return rw.run_metrics(customers, CONTACTS, within=within)


def remaining_plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.remaining_plaintext(_customers(spark, sf_dir), CONTACTS)


def idempotency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.idempotency_report(_customers(spark, sf_dir), CONTACTS, passes=REPORT_PASSES)


def sql_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql_functions(spark)
    customers = _customers(spark, sf_dir)
    return spark.sql(
        "SELECT id, tokenize_if_needed(email) AS email, is_token(phone) AS phone_is_token "
        "FROM {customers}",
        customers=customers,
    )


def tokenize_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_mode(
        TokenMode("sha256", lambda v: F.concat(F.lit("tok_"), F.sha2(v, 256), F.lit("_poc")))
    )
    return rw.tokenize(_customers(spark, sf_dir).select("id", "email"), ["email"], mode="sha256")


def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(table(spark, sf_dir, "customer"), "c_custkey")


# --- catalog --------------------------------------------------------------------------------------


def parse_urns(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = cat.split_urns(view(spark, sf_dir, "fx_catalog").select("k", "urn"))
    parts = [F.col(f"ref.{p}") for p in ("platform", "database", "schema_name", "table_name")]
    return good.select(
        "k", "urn", "ref.*", table_expression(*parts).alias("table_expression")
    )


def invalid_urns(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = cat.split_urns(view(spark, sf_dir, "fx_catalog").select("k", "urn"))
    return bad


def leaf_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = view(spark, sf_dir, "fx_fields")
    return fields.select("k", "pos", leaf_column(F.col("field_path")).alias("column_name"))


def field_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.field_map(view(spark, sf_dir, "fx_fields"), key="k")


def effective_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.tag_lists(_effective(spark, sf_dir), key="k")


def catalog_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = cat.flatten_payloads(view(spark, sf_dir, "fx_payload")).fields
    return fields.select(
        "urn", "field_path", "native_data_type", csv(F.col("tags")).alias("tags")
    )


def datasets_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = cat.flatten_payloads(view(spark, sf_dir, "fx_payload")).datasets
    return datasets.select(
        "urn",
        "name",
        csv(F.col("global_tags")).alias("global_tags"),
        F.try_element_at("properties", F.lit("owner")).alias("owner"),
    )


def search_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.search_dataset(view(spark, sf_dir, "fx_catalog"), *SEARCH).select("k", "urn")


def allowlist_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "fx_catalog").withColumns(
        {"schema_name": name_schema(F.col("name")), "table_name": name_table(F.col("name"))}
    )
    return cat.allow(named, ALLOW).select("k", "urn")


def list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.page(view(spark, sf_dir, "fx_catalog"), after=PAGE_AFTER).select("urn")


def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.run_requests(_datasets(spark, sf_dir), _fields(spark, sf_dir), key="k")


def tagged_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.tagged_field_counts(_fields(spark, sf_dir), key="k")


def crawl_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_parquet(spark, sf_dir).select(
        "table_name",
        "pos",
        F.col("field_path").alias("column_name"),
        F.col("native_data_type").alias("data_type"),
    )


def crawl_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a partitioned table whose later files have more of them, and of which only new footers are read."""
    root = workspace(spark, "crawl-evolved")
    orders = table(spark, sf_dir, "orders")
    own = ["o_orderkey", F.struct("o_custkey").alias("customer"), "o_orderstatus"]
    later = [F.lit(True).alias("late"), F.struct("o_totalprice", "o_custkey").alias("customer"), "o_orderkey", "o_orderstatus"]
    writes = (("o_orderstatus = 'F'", own), ("o_orderstatus != 'F'", later))
    for condition, columns in writes:
        orders.where(condition).select(*columns).write.mode("append").partitionBy("o_orderstatus").parquet(f"{root}/s/orders")
        crawled = crawl_parquet(spark, f"{root}/s", cache=f"{root}/footers")
    return crawled.select("table_name", "pos", F.col("field_path").alias("column_name"), F.col("native_data_type").alias("data_type"))


# --- detection ------------------------------------------------------------------------------------


def detect_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.explicit_columns(_fields(spark, sf_dir), _scope(spark, sf_dir), key="k")


def detect_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.tagged_columns(_effective(spark, sf_dir), key="k")


def detect_tagged_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.tagged_columns(_effective(spark, sf_dir), key="k", boundary=True)


def detect_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.heuristic_columns(_fields(spark, sf_dir), key="k")


def detect_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = det.Rules.from_dict(CUSTOM_RULES)
    return det.heuristic_columns(_fields(spark, sf_dir), rules, key="k")


def detector_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.rule_usage(_fields(spark, sf_dir), key="k")


def sample_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.profile_rows(_profile(spark, sf_dir))


def detect_many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of all documents that contain words of benchmark items, and how many of these."""

    def words(name: str, column: str) -> DataFrame:
        found = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
        return table(spark, sf_dir, name).select(F.explode(found).alias(column)).distinct()

    found = names_by_patterns(words("documents", "name"), words("benchmark", "pattern"))
    return found.groupBy("name").agg(F.count("*").alias("n_patterns"))


def detect_custom_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled columns by validators with groups, references, looks around and comments."""
    rules = det.Rules(validators=CUSTOM_VALIDATORS)
    return det.profile_rows(det.profile_samples(view(spark, sf_dir, "fx_samples"), rules, keys=["col"]), rules)


def sample_profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = view(spark, sf_dir, "fx_numbers")
    return det.profile_rows(det.profile_samples(numbers, keys=["col"]))


def profile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All string columns of all given tables: one scan per table, all columns in it at once."""
    crawled = crawl_parquet(spark, sf_dir).where("native_data_type = 'string'")
    parts = []
    for found in crawled.select("table_name", "location").distinct().orderBy(
        "table_name"
    ).toLocalIterator():
        profile = det.profile_table(spark.read.parquet(found.location))
        parts.append(
            det.profile_rows(profile).select(
                F.lit(found.table_name).alias("table_name"), *profile.columns[:2], "validator",
                "any_match",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def profile_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all string columns of all given tables, merged from two parts of each table."""
    crawled = crawl_parquet(spark, sf_dir).where("native_data_type = 'string'")

    def sample(found: Row) -> DataFrame:
        df = spark.read.parquet(found.location)
        half = F.pmod(F.xxhash64(*df.columns), F.lit(2))
        first = column_samples(df.where(half == 0), k=100)
        second = column_samples(df.where(half == 1), k=100, known=first)
        return merge_samples(first, second, k=100).withColumn("table_name", F.lit(found.table_name))

    places = crawled.select("table_name", "location").distinct().orderBy("table_name")
    with ThreadPoolExecutor(4) as pool:  # a table's jobs are small and wait for each other
        return reduce(DataFrame.unionByName, pool.map(sample, places.toLocalIterator()))


def detect_with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.heuristic_columns(
        _fields(spark, sf_dir),
        profile=_profile(spark, sf_dir).withColumnRenamed("col", "column_name"),
        key="k",
        profile_keys=["column_name"],
    )


def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _stored_catalog(spark, sf_dir)
    return det.detect(
        catalog.datasets,
        catalog.fields,
        scope=_scope(spark, sf_dir),
        profile=_profile(spark, sf_dir).withColumnRenamed("col", "column_name"),
        key="k",
        profile_keys=["column_name"],
    )


# --- tags and runs --------------------------------------------------------------------------------


def _after(spark: SparkSession, sf_dir: str, status: str) -> cat.Catalog:
    catalog = _stored_catalog(spark, sf_dir)
    requests = stored(cat.run_requests(catalog.datasets, catalog.fields, key="k"), "requests")
    asked = requests.select("k").distinct()
    targets = det.detect(
        asked,
        catalog.fields.join(asked, "k", "left_semi"),
        scope=requests.select("k", F.col("field_path").alias("name")),
        key="k",
    )
    outcomes = asked.withColumn("status", F.lit(status))
    return tags.apply_outcomes(catalog, outcomes, targets.select("k", "column_name"), key="k")


def _all_tags(catalog: cat.Catalog) -> DataFrame:
    datasets = catalog.datasets.select(
        "k", F.lit("").alias("field_path"), csv(F.col("global_tags")).alias("tags")
    )
    return datasets.unionByName(cat.tag_lists(catalog.fields, key="k"))


def apply_success_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_tags(_after(spark, sf_dir, "SUCCESS"))


def apply_failure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_tags(_after(spark, sf_dir, "FAILED"))


def catalog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs of everything asked for change between two snapshots of the catalog."""
    return tags.catalog_changes(_stored_catalog(spark, sf_dir), _written(_after(spark, sf_dir, "SUCCESS")), key="k")


def tag_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_state(view(spark, sf_dir, "fx_tagevents"))


def _run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "fx_runs")
    names = F.filter(F.split("columns", ","), lambda c: c != "")
    rows = found.withColumns(
        {
            "columns": F.array_sort(names),
            "rows_updated": F.col("rows_updated").cast("bigint"),
            "rows_skipped": F.col("rows_skipped").cast("bigint"),
            "ended_at": F.lit(None).cast("timestamp_ntz"),
        }
    )
    message = success_message(F.col("columns"), F.col("rows_updated"), F.col("rows_skipped"))
    return rows.withColumn(
        "message", F.when(F.col("status") == "SUCCESS", message).otherwise(F.lit("failed"))
    )


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest_runs(_run_rows(spark, sf_dir), order=["seq"])


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select(
        "urn", "run_id", iso_timestamp(F.col("started_at")).alias("started_at"), "status",
        "rows_updated",
    )


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    urns = view(spark, sf_dir, "fx_tagevents").select("urn").distinct()
    return runs.run_outcomes(urns, _latest(spark, sf_dir))


def status_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.create_map(F.lit("owner"), F.col("urn"), F.lit(STATUS_PROPERTY), F.lit("old"))
    recorded = runs.with_status_property(_latest(spark, sf_dir), before)
    run = recorded.select("urn", "properties", parse_status(F.col("properties")).alias("run"))
    return run.select(
        "urn",
        "run.run_id",
        "run.started_at",
        "run.ended_at",
        "run.status",
        F.array_join("run.columns", ",").alias("columns"),
        "run.rows_updated",
        F.col("properties")["owner"].alias("owner"),
    )


def run_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_rows(spark, sf_dir).where("status = 'SUCCESS'").select("run_id", "message")


def process_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole cycle over tables written from the given ones: crawl, tag, run, audit."""
    root = workspace(spark, "process-runs")
    customers = _customers(spark, sf_dir)
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "event_type", F.col("props").alias("contact_info")
    )
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("body"), "lang"
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    numbers = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("phone")
    )
    stores = {
        "postgres": {"customers": customers, "parts": parts, "numbers": numbers},
        "databricks": {"events": events, "documents": documents},
        "mysql": {"legacy_customers": customers.select("id", "email")},
    }
    crawled, platforms = [], {}
    for platform, tables in stores.items():
        folder = f"{root}/{platform}/main/public"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        crawled.append(
            crawl_parquet(
                spark, folder, platform=platform, database="main", schema_name="public"
            )
        )
        platforms[platform] = ParquetTables(f"{root}/{platform}", f"{root}/{platform}-new")
    del platforms["mysql"]

    def urn(platform: str, name: str) -> str:
        return f"urn:li:dataset:(urn:li:dataPlatform:{platform},main.public.{name},PROD)"

    asked = [
        (urn("postgres", "customers"), "", RUN_TAG),
        (urn("postgres", "parts"), "", RUN_TAG),
        (urn("postgres", "numbers"), "", RUN_TAG),
        (urn("mysql", "legacy_customers"), "", RUN_TAG),
        (urn("databricks", "events"), "event_type", RUN_TAG),
        (urn("databricks", "documents"), "", RUN_TAG),
        (urn("databricks", "documents"), "body", "urn:li:tag:sensitive"),
    ]
    state = local_rows(spark, asked, "urn string, field_path string, tag string")
    found = to_catalog(reduce(DataFrame.unionByName, crawled))
    catalog = _written(tags.with_tags(found, state))
    config = RunConfig(platforms=platforms, audit=f"{root}/audit")
    result = run_cycle(spark, catalog, config)
    return result.audit.select(
        "urn", "status", "rows_updated", csv(F.col("columns")).alias("columns"), "message"
    )


def _dataset(platform: str, name: str) -> str:
    return f"urn:li:dataset:(urn:li:dataPlatform:{platform},main.{name},PROD)"


def _asking(spark: SparkSession, crawled: DataFrame, *urns: str) -> cat.Catalog:
    """The catalog of crawled tables with run tags."""
    state = local_rows(spark, [(u, "", RUN_TAG) for u in urns], "urn string, field_path string, tag string")
    return _written(tags.with_tags(to_catalog(crawled), state))


def process_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table with evolved columns after a cycle that replaced its files with plaintext."""
    root = workspace(spark, "process-partitioned")
    folder = f"{root}/main/public/shipments"
    rows = view(spark, sf_dir, "fx_shipments")
    for part in (rows.where("note IS NULL").drop("note"), rows.where("note IS NOT NULL")):
        part.write.mode("append").partitionBy("hour").parquet(folder)
    crawled = crawl_parquet(spark, f"{root}/main/public", platform="postgres", database="main", schema_name="public")
    tables = FileTables(root, {"public.shipments": ["hour"]})
    catalog = _asking(spark, crawled, _dataset("postgres", "public.shipments"))
    run_cycle(spark, catalog, RunConfig({"postgres": tables}, f"{root}/audit"))
    return read_parquet(spark, folder, ["hour"]).select("id", "email", "note", "hour")


def published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the session's catalog, read by their own names after a cycle."""
    root = workspace(spark, "published")
    database = "published_" + root.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{root}/tables'")
    _customers(spark, sf_dir).write.saveAsTable(f"{database}.customers")
    view(spark, sf_dir, "fx_shipments").write.partitionBy("hour").saveAsTable(f"{database}.shipments")
    crawled = crawl_database(spark, database, platform="postgres").withColumn("database", F.lit("main"))
    catalog = _asking(spark, crawled, *[_dataset("postgres", f"{database}.{n}") for n in ("customers", "shipments")])
    run_cycle(spark, catalog, RunConfig({"postgres": PublishedTables(f"{root}/retired")}, f"{root}/audit"))
    customers = spark.table(f"{database}.customers").select(F.lit("customers").alias("name"), "id", "email", "phone")
    shipments = spark.table(f"{database}.shipments").select(F.lit("shipments").alias("name"), "id", "email", F.col("hour").alias("phone"))
    return customers.unionByName(shipments)


def _store(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Crawled tables of which one can be tokenized, one holds nothing to do, and one fails."""
    folder = f"{root}/main/public"
    _customers(spark, sf_dir).write.parquet(f"{folder}/customers")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name").write.parquet(f"{folder}/parts")
    orders = table(spark, sf_dir, "orders")
    orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("phone")).write.parquet(f"{folder}/numbers")
    return crawl_parquet(spark, folder, platform="postgres", database="main", schema_name="public")


def cycle_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dataset's status property after a cycle; one dataset was not asked for."""
    root = workspace(spark, "cycle-properties")
    crawled = _store(spark, sf_dir, root)
    catalog = _asking(spark, crawled, *[_dataset("postgres", f"public.{n}") for n in ("customers", "numbers")])
    result = run_cycle(spark, catalog, RunConfig({"postgres": FileTables(root)}, f"{root}/audit"))
    run = parse_status(F.col("properties"))
    rows = result.catalog.datasets.select("urn", csv(F.col("global_tags")).alias("tags"), run.alias("run"))
    updated = F.coalesce("run.rows_updated", F.lit(-1).cast("long")).alias("rows_updated")
    return rows.select("urn", "tags", "run.status", updated, F.array_join("run.columns", ",").alias("columns"), "run.message")


# --- streaming ------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return reader.parquet(sf_dir)


def stream_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workspace(spark, "stream-tokenize")
    rows = _event_stream(spark, sf_dir).select("event_id", "event_type", "props")
    write_files(
        tokenize_stream(rows, ["props"]), f"{root}/rows", f"{root}/checkpoint"
    ).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/rows")


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workspace(spark, "stream-requests")
    name = "stream_" + root.rsplit("-", 1)[1]
    _event_stream(spark, sf_dir).createOrReplaceTempView(name)
    changes = view(spark, sf_dir, "fx_tagevents", events=name)
    loop = RequestLoop(spark, f"{root}/state")
    loop.start(changes, f"{root}/checkpoint").awaitTermination()
    spark.catalog.dropTempView(name)
    return loop.state()


def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags after streamed requests: runs of every table, a failed one tried again, and idle batches."""
    root = workspace(spark, "stream-runs")
    crawled = stored(_store(spark, sf_dir, root), "crawled")
    schema = "urn string, field_path string, tag string, op string, seq bigint"
    # every customer's event asks for the customers, or takes that back; the last word is to run
    events = table(spark, sf_dir, "events").select(
        F.lit(_dataset("postgres", "public.customers")).alias("urn"),
        F.lit("").alias("field_path"),
        F.lit(RUN_TAG).alias("tag"),
        F.when(F.col("event_type") == "error", F.lit("remove")).otherwise(F.lit("add")).alias("op"),
        F.col("event_id").alias("seq"),
    )
    last = (1 << 40, RUN_TAG)
    more = [(_dataset("postgres", f"public.{n}"), "", last[1], "add", last[0]) for n in ("customers", "numbers", "parts")]
    events.unionByName(local_rows(spark, more, schema)).write.parquet(f"{root}/changes")
    loop = RequestLoop(
        spark,
        f"{root}/state",
        catalog=_written(to_catalog(crawled)),
        config=RunConfig({"postgres": FileTables(root)}, f"{root}/audit"),
    )
    changes = spark.readStream.schema(schema).parquet(f"{root}/changes")
    loop.start(changes, f"{root}/checkpoint").awaitTermination()
    for batch in (1, 2):
        loop.process_batch(local_rows(spark, [], schema), batch)
    return loop.state()


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_customers,
        tokenize_documents,
        tokenize_limited,
        tokenize_limited_large,
        token_candidates,
        token_flags,
        tokenize_arrays,
        run_metrics,
        run_metrics_limited,
        remaining_plaintext,
        idempotency_report,
        sql_tokenize,
        tokenize_mode,
        seed_rows,
        parse_urns,
        invalid_urns,
        leaf_columns,
        field_map,
        effective_tags,
        catalog_from_json,
        datasets_from_json,
        search_dataset,
        allowlist_datasets,
        list_datasets,
        run_requests,
        tagged_field_counts,
        crawl_catalog,
        crawl_evolved,
        detect_explicit,
        detect_tagged,
        detect_tagged_boundary,
        detect_heuristic,
        detect_custom_rules,
        detect_custom_validators,
        detect_many_patterns,
        detector_rules,
        sample_profile,
        sample_profile_numeric,
        profile_tables,
        profile_bottom_k,
        detect_with_samples,
        detect_all,
        apply_success_tags,
        apply_failure_tags,
        catalog_changes,
        tag_state,
        latest_runs,
        run_outcomes,
        status_properties,
        run_messages,
        process_runs,
        process_partitioned,
        published_tables,
        cycle_properties,
        stream_tokenize,
        stream_requests,
        stream_runs,
    )
}
