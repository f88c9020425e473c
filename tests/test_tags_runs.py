import json

from cloakwork.functions.status import STATUS_SCHEMA
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cloakwork.constants import (
    DONE_TAG, FAILED_TAG, RUN_TAG, STATUS_PROPERTY, SUCCESS_TAG, TOKENIZED_TAG,
)
from cloakwork.functions import (
    add_and_remove, iso_timestamp, outcome, parse_status, status_json, success_message,
    upsert_property,
)
from cloakwork.operators import runs, tags
from cloakwork.operators.catalog import Catalog

CHANGE = "urn string, field_path string, tag string, op string, seq bigint"
STATUS = (
    "run_id string, started_at timestamp, ended_at timestamp, platform string, "
    "columns array<string>, rows_updated bigint, rows_skipped bigint, status string, message string"
)


def test_last_change_wins(spark):
    df = spark.createDataFrame(
        [("u", "", "a", "add", 1), ("u", "", "a", "remove", 3), ("u", "", "a", "add", 2),
         ("u", "f", "a", "add", 1), ("v", "", "b", "remove", 1)], CHANGE
    )
    assert [tuple(r) for r in tags.tag_state(df).collect()] == [("u", "f", "a")]
    halves = tags.fold_changes(df.where("seq = 1")).unionByName(tags.fold_changes(df.where("seq > 1")))
    assert tags.fold_changes(halves).exceptAll(tags.fold_changes(df)).isEmpty()


def test_fold_sends_one_row_per_tag(spark, small):
    from verification.fixtures import view

    df = tags.tag_state(view(spark, small, "fx_tagevents"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_max" in plan
    assert "SortAggregate" not in plan


def test_tag_change_rows(spark):
    entities = spark.createDataFrame([("u", None, 4)], "urn string, field_path string, seq bigint")
    assert tuple(tags.tag_changes(entities, "t", "add").first()) == ("u", "", "t", "add", 4)
    with pytest.raises(ValueError):
        tags.tag_changes(entities, "t", "drop")


def test_removals_come_before_additions(spark):
    df = spark.createDataFrame([(["a", "b"],), (None,)], "t array<string>")
    got = df.select(add_and_remove(F.col("t"), ["b", "c"], ["a", "b"])).collect()
    assert [r[0] for r in got] == [["b", "c"], ["b", "c"]]


def catalog(spark):
    datasets = spark.createDataFrame(
        [("ok", [RUN_TAG, FAILED_TAG, "x"]), ("bad", [RUN_TAG, SUCCESS_TAG]), ("idle", [RUN_TAG])],
        "urn string, global_tags array<string>",
    )
    fields = spark.createDataFrame(
        [("ok", 0, "t.email", ["pii"]), ("ok", 1, "u.email", [RUN_TAG]), ("ok", 2, "t.city", [RUN_TAG]),
         ("ok", 3, "t.n", None), ("bad", 0, "t.email", [RUN_TAG]), ("idle", 0, "t.email", [RUN_TAG])],
        "urn string, pos int, field_path string, tags array<string>",
    )
    outcomes = spark.createDataFrame([("ok", "SUCCESS"), ("bad", "FAILED")], "urn string, status string")
    targets = spark.createDataFrame(
        [("ok", "email"), ("bad", "email"), ("ok", None)], "urn string, column_name string"
    )
    return Catalog(datasets, fields), outcomes, targets


def test_transitions(spark):
    before, outcomes, targets = catalog(spark)
    after = tags.apply_outcomes(before, outcomes, targets)
    assert {r.urn: set(r.global_tags) for r in after.datasets.collect()} == {
        "ok": {"x", DONE_TAG, SUCCESS_TAG},
        "bad": {RUN_TAG, FAILED_TAG},
        "idle": {RUN_TAG},
    }
    got = {(r.urn, r.field_path): set(r.tags or []) for r in after.fields.collect()}
    assert got == {
        ("ok", "t.email"): {"pii", TOKENIZED_TAG},
        ("ok", "u.email"): {TOKENIZED_TAG},
        ("ok", "t.city"): set(),
        ("ok", "t.n"): set(),
        ("bad", "t.email"): {RUN_TAG},
        ("idle", "t.email"): {RUN_TAG},
    }
    assert after.fields.columns == before.fields.columns


def test_transitions_as_changes_give_the_same_tags(spark):
    before, outcomes, targets = catalog(spark)
    start = before.datasets.select("urn", F.lit("").alias("field_path"), F.explode("global_tags").alias("tag"))
    start = start.unionByName(before.fields.select("urn", "field_path", F.explode("tags").alias("tag")))
    log = start.withColumns({"op": F.lit("add"), "seq": F.lit(1)})
    log = log.unionByName(tags.outcome_changes(before.fields, outcomes, targets).withColumn("seq", F.lit(2)))
    after = tags.apply_outcomes(before, outcomes, targets)
    want = after.datasets.select("urn", F.lit("").alias("field_path"), F.explode("global_tags").alias("tag"))
    want = want.unionByName(after.fields.select("urn", "field_path", F.explode("tags").alias("tag")))
    assert {tuple(r) for r in tags.tag_state(log).collect()} == {tuple(r) for r in want.collect()}


def test_tags_of_unknown_fields_are_ignored(spark):
    before, _, _ = catalog(spark)
    state = spark.createDataFrame(
        [("ok", "", "new"), ("ok", "t.n", "n"), ("ok", "ghost", "g")], "urn string, field_path string, tag string"
    )
    after = tags.with_tags(before, state)
    assert "new" in after.datasets.where("urn = 'ok'").first().global_tags
    assert after.fields.where("field_path = 't.n'").first().tags == ["n"]
    assert after.fields.count() == before.fields.count()


def status_row(spark, ended=datetime(2031, 7, 9, 23, 59, 59, 250000)):
    row = ("run-7", datetime(2031, 7, 9, 8, 30), ended, "databricks", [], 0, 3, "FAILED", 'No "table"\nhere')
    return spark.createDataFrame([row], STATUS)


def test_status_json(spark):
    got = json.loads(status_row(spark).select(status_json()).first()[0])
    assert got == dict(zip(
        [f.split()[0] for f in STATUS_SCHEMA.split(", ")],
        ["run-7", "2031-07-09T08:30:00", "2031-07-09T23:59:59.250000", "databricks", [], 0, 3, "FAILED", 'No "table"\nhere'],
    ))
    open_ = json.loads(status_row(spark, None).select(status_json()).first()[0])
    assert open_["ended_at"] is None and len(open_) == 9


@pytest.mark.parametrize("micros", [0, 5, 120000])
def test_iso_timestamps_equal_python(spark, micros):
    value = datetime(2024, 2, 3, 4, 5, 6, micros)
    df = spark.createDataFrame([(value,)], "t timestamp_ntz")
    assert df.select(iso_timestamp(F.col("t"))).first()[0] == value.isoformat()


def test_iso_timestamps_are_utc_in_any_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp'2024-01-01 12:00:00.5Z' AS t, timestamp_ntz'2024-01-01 12:00:00' AS n")
        df = df.select(iso_timestamp(F.col("t")), iso_timestamp(F.col("n")))
        assert tuple(df.first()) == ("2024-01-01T12:00:00.500000", "2024-01-01T12:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_property_keeps_the_others(spark):
    df = status_row(spark).withColumn("old", F.create_map(F.lit("n"), F.lit(5), F.lit(STATUS_PROPERTY), F.lit(6)))
    new = df.select(upsert_property(F.col("old"), STATUS_PROPERTY, status_json()).alias("p"))
    row = new.select("p", parse_status(F.col("p")).alias("s")).first()
    assert row.p["n"] == "5" and set(row.p) == {"n", STATUS_PROPERTY}
    assert (row.s.run_id, row.s.rows_skipped, row.s.columns) == ("run-7", 3, [])
    none = spark.sql("SELECT CAST(NULL AS map<string,string>) AS p")
    assert none.select(parse_status(F.col("p"))).first()[0] is None
    assert none.select(upsert_property(F.col("p"), "k", F.lit("v"))).first()[0] == {"k": "v"}


def test_messages(spark):
    df = spark.createDataFrame([([], 0), (["a", "b"], 3)], "c array<string>, n bigint")
    got = df.select(success_message(F.col("c"), F.col("n"), F.lit(0))).collect()
    assert [r[0] for r in got] == [
        "No PII columns detected; nothing to tokenise.", "Tokenised columns a, b; updated 3 rows, skipped 0.",
    ]


def test_outcomes(spark):
    df = spark.createDataFrame([("SUCCESS",), ("FAILED",), (None,), ("?",)], "s string")
    assert [r[0] for r in df.select(outcome(F.col("s"))).collect()] == ["done", "failed", "waiting", "unknown"]


def test_outcome_of_one_run_is_not_that_of_an_earlier_one(spark):
    audit = spark.createDataFrame(
        [("u", "r1", "SUCCESS", 1), ("u", "r2", "FAILED", 2), ("v", "r3", "SUCCESS", 1)],
        "urn string, run_id string, status string, seq int",
    )
    latest = runs.latest_runs(audit, order=["seq"])
    asked = spark.createDataFrame([("u", "r9"), ("w", "r3")], "urn string, run_id string")
    assert {r.urn: r.outcome for r in runs.run_outcomes(asked, latest).collect()} == {"u": "failed", "w": "waiting"}
    by_run = runs.run_outcomes(asked, audit, on=["urn", "run_id"])
    assert {r.urn: r.outcome for r in by_run.collect()} == {"u": "waiting", "w": "waiting"}


def test_an_addition_wins_a_tie(spark):
    rows = [("u", "", "t", "add", 1), ("u", "", "t", "remove", 1)]
    for order in (rows, rows[::-1]):
        changes = spark.createDataFrame(order, "urn string, field_path string, tag string, op string, seq long")
        assert tags.tag_state(changes.coalesce(1)).count() == 1


def test_changes_lead_from_one_catalog_to_the_other(spark):
    old, _, _ = catalog(spark)
    state = spark.createDataFrame([("ok", "", "new"), ("ok", "t.n", "n")], "urn string, field_path string, tag string")
    new = tags.with_tags(old, state, old.datasets.select("urn", F.lit("").alias("field_path"), F.explode("global_tags").alias("tag")).limit(1))
    found = tags.catalog_changes(old, new)
    assert {r.op for r in found.collect()} == {"add", "remove"} and tags.catalog_changes(new, new).isEmpty()
    again = tags.with_tags(old, found.where("op = 'add'"), found.where("op = 'remove'"))
    assert tags.catalog_changes(again, new).isEmpty()
    gone = type(old)(old.datasets.where("urn <> 'ok'"), old.fields.where("urn <> 'ok'"))
    assert {r.op for r in tags.catalog_changes(old, gone).collect()} <= {"remove"}


def test_names_by_many_patterns(spark):
    from cloakwork.operators.many import names_by_patterns

    names = ["Work_Email", "work_email", "e", "", None, "phonephone", "ΑΒΓΔ", "x.y", "aa"]
    patterns = ["EMAIL", "email", "e", "_e", "one", "αβγ", "zzz", "y", "phonephonep", None, "x.y", "aaa"]
    for extra in ([], [""]):
        found = names_by_patterns(
            spark.createDataFrame([(n,) for n in names + names], "name string"),
            spark.createDataFrame([(p,) for p in patterns + extra], "pattern string"),
        ).collect()
        want = {(n, p.lower()) for n in names if n is not None for p in patterns + extra if p is not None and p.lower() in n.lower()}
        assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert names_by_patterns(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([], "pattern string")).isEmpty()
