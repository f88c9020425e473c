from pyspark.sql import functions as F

from cloakwork.constants import DONE_TAG, FAILED_TAG, RUN_TAG, SUCCESS_TAG
from cloakwork.operators import rewrite as rw
from cloakwork.operators import tags
from cloakwork.plans.cycle import RunConfig
from cloakwork.sources.crawl import crawl_parquet, to_catalog
from cloakwork.sources.seed import seed_contacts
from cloakwork.sources.tables import ParquetTables
from cloakwork.streaming.requests import RequestLoop
from cloakwork.streaming.rows import tokenize_stream, write_batches, write_files

CHANGE = "urn string, field_path string, tag string, op string, seq bigint"
CUSTOMERS = "urn:li:dataset:(urn:li:dataPlatform:postgres,main.public.customers,PROD)"


def arrive(spark, rows, path, schema=CHANGE):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_arriving_rows_give_the_batch_result(spark, folder):
    schema = seed_contacts(spark, 1).schema
    for start in (0, 100, 200):
        rows = seed_contacts(spark).withColumn("id", F.col("id") + start).coalesce(1)
        rows.write.mode("append").parquet(f"{folder}/in")
    for write in (write_files, write_batches):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        out = f"{folder}/{write.__name__}"
        write(tokenize_stream(stream, ["email", "phone"]), out, f"{out}-checkpoint").awaitTermination()
        got = spark.read.parquet(out).select("id", "email", "phone")
        want = rw.tokenize(spark.read.parquet(f"{folder}/in"), ["email", "phone"])
        assert got.count() == 300 and got.exceptAll(want).isEmpty()


def test_state_over_batches_equals_the_fold_of_everything(spark, folder, small):
    from verification.fixtures import view

    events = view(spark, small, "fx_tagevents")
    for number in range(4):  # out of order over the batches
        events.where(F.col("seq") % 4 == 3 - number).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    loop = RequestLoop(spark, f"{folder}/state")
    query = loop.start(stream, f"{folder}/checkpoint")
    query.awaitTermination()
    assert query.lastProgress.batchId >= 3
    want = {tuple(r) for r in tags.tag_state(events).collect()}
    assert {tuple(r) for r in loop.state().collect()} == want


def test_running_a_batch_again_changes_nothing(spark, folder):
    loop = RequestLoop(spark, f"{folder}/state")
    first = spark.createDataFrame([("u", "", "a", "add", 1), ("u", "", "b", "add", 2)], CHANGE)
    second = spark.createDataFrame([("u", "", "a", "remove", 3)], CHANGE)
    loop.process_batch(first, 0)
    for _ in range(2):
        loop.process_batch(second, 1)
        assert [tuple(r) for r in loop.state().collect()] == [("u", "", "b")]


def test_requests_run_fail_and_are_tried_again(spark, folder):
    source = f"{folder}/source/main/public"
    seed_contacts(spark).write.parquet(f"{source}/customers")
    catalog = to_catalog(
        crawl_parquet(spark, source, platform="postgres", database="main", schema_name="public")
    )
    platforms = {}
    config = RunConfig(platforms, f"{folder}/audit")
    loop = RequestLoop(spark, f"{folder}/state", catalog=catalog, config=config)

    def dataset_tags():
        return {r.tag for r in loop.state().where("field_path = ''").collect()}

    def cycle(rows):
        arrive(spark, rows, f"{folder}/in")
        stream = spark.readStream.schema(CHANGE).parquet(f"{folder}/in")
        loop.start(stream, f"{folder}/checkpoint").awaitTermination()

    cycle([(CUSTOMERS, "", RUN_TAG, "add", 1)])  # nowhere to find the table yet
    assert dataset_tags() == {RUN_TAG, FAILED_TAG}

    platforms["postgres"] = ParquetTables(f"{folder}/source", f"{folder}/target")
    cycle([("other", "", "note", "add", 2)])  # any next batch tries again
    assert dataset_tags() == {DONE_TAG, SUCCESS_TAG, "note"}
    state = loop.state().where("field_path <> ''")
    assert sorted(r.field_path for r in state.collect()) == ["email", "phone"]

    cycle([(CUSTOMERS, "", RUN_TAG, "add", 3)])  # a later request runs once more
    assert dataset_tags() == {DONE_TAG, SUCCESS_TAG, "note"}
    audit = spark.read.parquet(f"{folder}/audit").orderBy("started_at")
    assert [(r.status, r.rows_updated) for r in audit.collect()] == [
        ("FAILED", 0), ("SUCCESS", 100), ("SUCCESS", 0),
    ]


def test_poll_tries_pending_requests_without_new_changes(spark, folder):
    source = f"{folder}/source/main/public"
    seed_contacts(spark).write.parquet(f"{source}/customers")
    catalog = to_catalog(
        crawl_parquet(spark, source, platform="postgres", database="main", schema_name="public")
    )
    platforms = {}
    loop = RequestLoop(
        spark, f"{folder}/state", catalog=catalog, config=RunConfig(platforms, f"{folder}/audit")
    )
    loop.process_batch(spark.createDataFrame([(CUSTOMERS, "email", RUN_TAG, "add", 1)], CHANGE), 0)
    platforms["postgres"] = ParquetTables(f"{folder}/source", f"{folder}/target")
    assert [(r.status, r.columns) for r in loop.poll().audit.collect()] == [("SUCCESS", ["email"])]
    assert loop.poll().audit.isEmpty()
