"""The audit's files, its journal, and a request loop that stays small and goes on after errors."""

import pathlib
import uuid
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from cloakwork.constants import DONE_TAG, FAILED_TAG, RUN_TAG, STATUS_PROPERTY, SUCCESS_TAG
from cloakwork.functions.status import parse_status
from cloakwork.operators.catalog import Catalog
from cloakwork.operators.rewrite import candidates
from cloakwork.operators.runs import latest_runs
from cloakwork.operators.tags import with_tags
from cloakwork.plans import cycle as plan
from cloakwork.plans.cycle import RunConfig, run_cycle
from cloakwork import session
from cloakwork.session import scratch_removed, stored
from cloakwork.sources import audit as log_module
from cloakwork.sources.audit import INTERRUPTED_MESSAGE, AuditLog
from cloakwork.sources.crawl import crawl_parquet, to_catalog
from cloakwork.sources.published import FileTables
from cloakwork.sources.seed import seed_contacts
from cloakwork.streaming.requests import RequestLoop

CHANGE = "urn string, field_path string, tag string, op string, seq bigint"


def urn(name):
    return f"urn:li:dataset:(urn:li:dataPlatform:postgres,main.public.{name},PROD)"


def run_row(name, number, status="SUCCESS"):
    at = datetime.fromtimestamp(1_700_000_000 + number, timezone.utc)
    return (f"run{number}", urn(name), at, at, "postgres", ["email"], number, 0, 0, status, "m", None)


def files(folder):
    return sorted(str(p) for p in pathlib.Path(folder).rglob("*") if p.is_file())


@pytest.fixture()
def store(spark, folder):
    place = f"{folder}/tables/main/public"
    for name in ("a", "b", "c"):
        seed_contacts(spark).coalesce(1).write.parquet(f"{place}/{name}")
    catalog = to_catalog(crawl_parquet(spark, place, platform="postgres", database="main", schema_name="public"))
    return Catalog(stored(catalog.datasets, "d"), stored(catalog.fields, "f")), FileTables(f"{folder}/tables")


def asking(spark, catalog, *names):
    state = spark.createDataFrame([(urn(n), "", RUN_TAG) for n in names], "urn string, field_path string, tag string")
    return with_tags(catalog, state)


def test_many_runs_give_few_files(spark, folder):
    log = AuditLog(spark, folder, seconds=10**6)
    log.begin("c", [(f"run{i}", urn(f"t{i}"), datetime.now(timezone.utc), "postgres", []) for i in range(10_000)])
    for i in range(10_000):
        log.end("c", [run_row(f"t{i}", i)])
    log.close("c")
    assert len([f for f in files(folder) if f.endswith(".parquet")]) < 100
    assert log.rows().count() == 10_000 and latest_runs(log.rows()).count() == 10_000


def test_folding_loses_nothing_and_repeats_nothing(spark, folder, monkeypatch):
    monkeypatch.setattr(log_module, "FOLD", 3)
    log = AuditLog(spark, folder)
    want = set()
    for i in range(10):
        cycle = uuid.uuid4().hex
        log.end(cycle, [run_row("t", i)])
        log.close(cycle)
        want.add(f"run{i}")
        log.fold()
        assert sorted(r.run_id for r in log.rows().collect()) == sorted(want)
    assert len(log._complete()) <= 6


@pytest.mark.parametrize("stage", ["note", "rows"])
def test_a_fold_cut_short(spark, folder, monkeypatch, stage):
    monkeypatch.setattr(log_module, "FOLD", 3)
    log = AuditLog(spark, folder)
    for i in range(3):
        log.end(f"c{i}", [run_row("t", i)])
        log.close(f"c{i}")

    def cut(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(AuditLog, "_read" if stage == "note" else "_finish", cut)
        with pytest.raises(KeyboardInterrupt):
            log.fold()
    assert sorted(r.run_id for r in log.rows().collect()) == ["run0", "run1", "run2"]
    log.fold()
    assert sorted(r.run_id for r in log.rows().collect()) == ["run0", "run1", "run2"] and len(log._complete()) == 1


@pytest.mark.parametrize("after", [0, 1])
def test_runs_after_the_end_of_a_driver(spark, folder, store, monkeypatch, after):
    """The driver ends between the write of a table and its audit row."""
    catalog, tables = store
    asked = asking(spark, catalog, "a", "b", "c")
    config = RunConfig({"postgres": tables}, f"{folder}/audit", parallel_tables=1)
    run_table, done = plan.run_table, []

    def ends(*args, **options):
        row = run_table(*args, **options)
        done.append(row)
        if len(done) > after:
            raise KeyboardInterrupt
        return row

    with monkeypatch.context() as broken:
        broken.setattr(plan, "run_table", ends)
        with pytest.raises(KeyboardInterrupt):
            run_cycle(spark, asked, config)
    run_cycle(spark, asked, config)
    log = AuditLog(spark, config.audit)
    rows = log.rows().collect()
    assert sorted(r.urn for r in rows if r.status == "SUCCESS") == [urn(n) for n in "abc"]
    assert {r.message for r in rows if r.status == "FAILED"} == {INTERRUPTED_MESSAGE}
    assert sorted(r.urn for r in rows if r.status == "FAILED") == [urn(n) for n in "abc"]
    assert len({r.run_id for r in rows}) == 6
    for name in "abc":
        assert candidates(spark.read.parquet(f"{folder}/tables/main/public/{name}"), ["email", "phone"]).isEmpty()
    assert latest_runs(log.rows()).where("status = 'SUCCESS'").count() == 3
    assert not list(pathlib.Path(f"{folder}/audit/_journal").glob("cycle=*"))
    assert log.recover() == 0


def test_every_run_is_recorded_on_its_dataset(spark, folder, store):
    catalog, tables = store
    numbers = f"{folder}/tables/main/public/a"
    asked = asking(spark, catalog, "a", "b")
    datasets = asked.datasets.withColumn("properties", F.create_map(F.lit("owner"), F.lit("x")))
    spark.range(3).selectExpr("id", "id AS email").write.mode("overwrite").parquet(numbers)
    result = run_cycle(spark, Catalog(datasets, asked.fields), RunConfig({"postgres": tables}, f"{folder}/audit"))
    rows = result.catalog.datasets.withColumn("run", parse_status(F.col("properties"))).collect()
    got = {r.urn: (r.run.status, r.run.rows_updated) if r.run else None for r in rows}
    assert got == {urn("a"): ("FAILED", 0), urn("b"): ("SUCCESS", 100), urn("c"): None}
    assert {r.properties["owner"] for r in rows} == {"x"}
    assert {r.urn: set(r.properties) for r in rows}[urn("a")] == {"owner", STATUS_PROPERTY}


# --- the loop ------------------------------------------------------------------------------------


def tags_of(loop, name):
    return {r.tag for r in loop.state().where((F.col("urn") == urn(name)) & (F.col("field_path") == "")).collect()}


def test_idle_batches_write_nothing(spark, folder, store, monkeypatch):
    catalog, tables = store
    made, real = [], session.workspace
    monkeypatch.setattr(session, "workspace", lambda *args: made.append(real(*args)) or made[-1])
    loop = RequestLoop(spark, f"{folder}/loop", catalog=catalog, config=RunConfig({"postgres": tables}, f"{folder}/audit"))
    nothing = spark.createDataFrame([], CHANGE)
    loop.process_batch(spark.createDataFrame([(urn("a"), "", RUN_TAG, "add", 1)], CHANGE), 0)
    assert tags_of(loop, "a") == {DONE_TAG, SUCCESS_TAG}
    for batch in (1, 2, 3):  # outcomes are folded, old state goes
        loop.process_batch(nothing, batch)
    before = files(f"{folder}/loop"), files(f"{folder}/audit")
    for batch in range(4, 24):
        loop.process_batch(nothing, batch)
    assert (files(f"{folder}/loop"), files(f"{folder}/audit")) == before
    assert made and not any(pathlib.Path(p.removeprefix("file:")).exists() for p in made)
    assert tags_of(loop, "a") == {DONE_TAG, SUCCESS_TAG}


def test_failed_runs_stay_small(spark, folder, store, monkeypatch):
    monkeypatch.setattr(log_module, "FOLD", 4)
    catalog, _ = store
    platforms = {}
    loop = RequestLoop(spark, f"{folder}/loop", catalog=catalog, config=RunConfig(platforms, f"{folder}/audit"))
    nothing = spark.createDataFrame([], CHANGE)
    loop.process_batch(spark.createDataFrame([(urn("a"), "", RUN_TAG, "add", 1)], CHANGE), 0)
    sizes = []
    for batch in range(1, 9):
        loop.process_batch(nothing, batch)
        assert tags_of(loop, "a") == {RUN_TAG, FAILED_TAG}
        sizes.append(len(files(f"{folder}/loop")) + len(files(f"{folder}/audit")))
    assert max(sizes[4:]) <= max(sizes[:4]) + 8
    platforms["postgres"] = FileTables(f"{folder}/tables")
    loop.process_batch(nothing, 9)
    assert tags_of(loop, "a") == {DONE_TAG, SUCCESS_TAG}
    rows = AuditLog(spark, f"{folder}/audit").rows()
    assert rows.count() == 10 and rows.where("status = 'SUCCESS'").count() == 1


def test_a_batch_run_again_keeps_what_runs_have_done(spark, folder, store):
    catalog, tables = store
    loop = RequestLoop(spark, f"{folder}/loop", catalog=catalog, config=RunConfig({"postgres": tables}, f"{folder}/audit"))
    nothing = spark.createDataFrame([], CHANGE)
    first = spark.createDataFrame([(urn("a"), "", RUN_TAG, "add", 1)], CHANGE)
    second = spark.createDataFrame([(urn("b"), "email", RUN_TAG, "add", 2), (urn("a"), "", "note", "add", 3)], CHANGE)
    for batch, changes in ((0, first), (0, first), (1, second), (1, second), (2, nothing), (2, nothing), (3, nothing)):
        loop.process_batch(changes, batch)
    assert tags_of(loop, "a") == {DONE_TAG, SUCCESS_TAG, "note"} and tags_of(loop, "b") == {DONE_TAG, SUCCESS_TAG}
    assert AuditLog(spark, f"{folder}/audit").rows().count() == 2


def test_requests_of_the_catalog_itself_end(spark, folder, store):
    catalog, tables = store
    asked = asking(spark, catalog, "c")
    loop = RequestLoop(spark, f"{folder}/loop", catalog=asked, config=RunConfig({"postgres": tables}, f"{folder}/audit"))
    for batch in range(3):
        loop.process_batch(spark.createDataFrame([], CHANGE), batch)
    assert AuditLog(spark, f"{folder}/audit").rows().count() == 1
    assert tags_of(loop, "c") == {DONE_TAG, SUCCESS_TAG}


def test_an_error_of_the_cycle_is_a_row(spark, folder, store, monkeypatch):
    catalog, tables = store
    loop = RequestLoop(spark, f"{folder}/loop", catalog=catalog, config=RunConfig({"postgres": tables}, f"{folder}/audit"))
    change = spark.createDataFrame([(urn("a"), "", RUN_TAG, "add", 1)], CHANGE)

    def broken(*_, **__):
        raise OSError("secret value")

    with monkeypatch.context() as m:
        m.setattr(plan, "decide", broken)
        loop.process_batch(change, 0)
    rows = AuditLog(spark, f"{folder}/audit").rows().collect()
    assert [(r.urn, r.status, r.message) for r in rows] == [(None, "FAILED", "OSError")]
    loop.process_batch(spark.createDataFrame([], CHANGE), 1)
    assert tags_of(loop, "a") == {DONE_TAG, SUCCESS_TAG}
    assert latest_runs(AuditLog(spark, f"{folder}/audit").rows()).count() == 1


def test_a_clock_tries_again_without_new_changes(spark, folder, store):
    catalog, tables = store
    platforms = {}
    loop = RequestLoop(spark, f"{folder}/loop", catalog=catalog, config=RunConfig(platforms, f"{folder}/audit"))
    spark.createDataFrame([(urn("a"), "", RUN_TAG, "add", 1)], CHANGE).coalesce(1).write.parquet(f"{folder}/in")
    query = loop.start(spark.readStream.schema(CHANGE).parquet(f"{folder}/in"), f"{folder}/checkpoint", interval=5)
    try:
        for _ in range(60):
            if query.lastProgress and query.lastProgress.batchId >= 1:
                break
            query.awaitTermination(1)
        assert tags_of(loop, "a") == {RUN_TAG, FAILED_TAG}
        platforms["postgres"] = tables
        seen = query.lastProgress.batchId
        for _ in range(60):
            if query.lastProgress.batchId >= seen + 2:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert tags_of(loop, "a") == {DONE_TAG, SUCCESS_TAG}


def test_scratch_of_other_threads_stays(spark):
    from threading import Thread

    other = []
    with scratch_removed(spark):
        mine = stored(spark.range(3), "mine")
        thread = Thread(target=lambda: other.append(stored(spark.range(3), "other")))
        thread.start()
        thread.join()
        place = mine.inputFiles()[0]
    assert other[0].count() == 3 and not pathlib.Path(place.removeprefix("file://")).exists()
