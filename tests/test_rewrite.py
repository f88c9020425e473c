import random

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import rewrite as rw
from verification.fixtures import view

CONTACTS = ["email", "phone"]


@pytest.fixture(scope="module")
def customers(spark, small):
    return view(spark, small, "fx_customers")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def contacts(spark, rows):
    return spark.createDataFrame(rows, "id bigint, email string, phone string, city string")


def test_rows_nulls_and_other_columns_are_kept(customers):
    done = rw.tokenize(customers, CONTACTS)
    assert done.columns == customers.columns
    nulls = [F.count_if(F.col(c).isNull()) for c in CONTACTS]
    assert customers.agg(F.count("*"), *nulls).first() == done.agg(F.count("*"), *nulls).first()
    assert customers.select("id", "city").exceptAll(done.select("id", "city")).isEmpty()


def test_unlimited_plan_has_no_shuffle_and_no_python(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    text = plan(rw.tokenize(documents, ["text"]))
    for word in ("Exchange", "Join", "Sort", "Python", "Arrow"):
        assert word not in text
    assert "WholeStageCodegen" in text or "*(1)" in text


def test_candidate_scan_reads_only_its_columns(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    text = plan(rw.candidates(documents, ["text"], key="doc_id"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "IsNotNull(text)" in text


@pytest.mark.parametrize("limit", [0, 1, 7, 100, 10_000])
def test_limit_changes_the_first_candidates_by_key(customers, limit):
    before = {r.id: r for r in customers.collect()}
    found = sorted(r.id for r in rw.candidates(customers, CONTACTS).collect())
    full = {r.id: r for r in rw.tokenize(customers, CONTACTS).collect()}
    for row in rw.tokenize(customers, CONTACTS, limit=limit).collect():
        want = full if row.id in set(found[:limit]) else before
        assert row == want[row.id]


def test_candidates_beyond_the_limit_are_counted(customers):
    found = rw.candidates(customers, CONTACTS)
    for limit in (0, 7, 100_000):
        within, beyond = rw.first_candidates(found, limit)
        assert beyond == max(0, found.count() - limit)
        assert rw.run_metrics(customers, CONTACTS, within=within).first().rows_remaining == beyond


def test_negative_limit(customers):
    with pytest.raises(rw.RewriteError, match="negative"):
        rw.tokenize(customers, CONTACTS, limit=-1)


def test_limited_plan_has_no_join(customers):
    assert "Join" not in plan(rw.tokenize(customers, CONTACTS, limit=10))


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_large_limits_count_instead_of_sorting(spark, monkeypatch, kind):
    monkeypatch.setattr(rw, "LAST_KEYS", 50)
    numbers = random.Random(7).sample(range(10_000_000), 3000)
    df = spark.createDataFrame([(n,) for n in numbers], "id bigint")
    df = df.select(F.col("id").cast(kind).alias("key"))
    keys = sorted(r.key for r in df.collect())
    for limit in (1, 50, 51, 1500, 2999, 3000, 3001):
        want = keys[limit - 1] if limit <= len(keys) else None
        assert rw.cutoff_key(df, limit) == want
        if want is not None:
            part, rank = rw.narrowed(df, limit, len(keys))
            left = sorted(r.key for r in part.collect())
            assert len(left) <= 50 and left[rank - 1] == want  # no more reaches the last task


def test_few_different_keys_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(rw, "LAST_KEYS", 50)
    for values in ((3, 8), (1, 2, 3), range(100)):
        df = spark.createDataFrame([(v,) for v in values for _ in range(100)], "key int")
        for limit in (1, 100, 101, 100 * len(values)):
            assert rw.cutoff_key(df, limit) == sorted(values)[(limit - 1) // 100]


def test_large_limit_rejects_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(rw, "LAST_KEYS", 50)
    df = spark.range(1000).select(F.lit(5).alias("key"))
    with pytest.raises(rw.RewriteError):
        rw.first_candidates(df, 500, key="key")


@pytest.mark.parametrize("keys", [[1, 1, 2], [None, 1, 2]])
def test_limit_needs_unique_keys(spark, keys):
    df = contacts(spark, [(k, f"a{i}@x.y", None, "c") for i, k in enumerate(keys)])
    with pytest.raises(rw.RewriteError, match="unique"):
        rw.tokenize(df, CONTACTS, limit=2)


def test_repeated_keys_are_safe_without_a_limit(spark):
    df = contacts(spark, [(1, "a", None, ""), (1, "b", None, ""), (None, "c", None, "")])
    got = [r.email for r in rw.tokenize(df, CONTACTS).collect()]
    assert sorted(got) == ["tok_YQ==_poc", "tok_Yg==_poc", "tok_Yw==_poc"]


def test_only_string_columns(spark):
    df = spark.createDataFrame([(1, 5, "x")], "id int, phone int, email string")
    with pytest.raises(rw.RewriteError, match="phone is int"):
        rw.tokenize(df, CONTACTS)
    done = rw.tokenize(df, CONTACTS, cast_non_string=True).first()
    assert done.phone == "tok_NQ==_poc"


def test_names_are_exact(spark):
    df = spark.createDataFrame([(1, "a", "b")], ["id", "a.b`c", "Email"])
    with pytest.raises(rw.RewriteError, match="email"):
        rw.tokenize(df, ["email"])
    with pytest.raises(rw.RewriteError, match="nope"):
        rw.tokenize(df, ["nope"])
    assert rw.tokenize(df, ["a.b`c"]).first()[1] == "tok_YQ==_poc"


def test_metrics_add_up(customers):
    row = rw.run_metrics(customers, CONTACTS).first()
    assert row.rows_scanned == row.rows_updated + row.rows_skipped + row.rows_clean
    assert row.rows_skipped == row.rows_remaining == 0
    assert row.cells_updated >= row.rows_updated > 0
    left = rw.remaining_plaintext(rw.tokenize(customers.where("email <> ''"), CONTACTS), CONTACTS)
    assert [r.remaining for r in left.orderBy("column_name").collect()] == [0, 0]


def test_trailing_newline_token_is_clean(spark):
    df = contacts(spark, [(1, "tok_YQ==_poc\n", None, "")])
    row = rw.run_metrics(df, CONTACTS).first()
    assert (row.rows_updated, row.rows_skipped, row.rows_clean) == (0, 0, 1)


def test_idempotency_report(spark, customers):
    passes = {r.pass_no: r.rows_updated for r in rw.idempotency_report(customers, CONTACTS, passes=4).collect()}
    empty = customers.where("email = ''").count()
    assert passes[1] > 0 and passes[2] == empty > 0
    assert passes[3] == passes[4] == 0
    seeded = customers.where("email <> ''")
    assert [r.rows_updated for r in rw.idempotency_report(seeded, CONTACTS).orderBy("pass_no").collect()][1] == 0


@pytest.mark.parametrize("top", [10, 1000])
def test_limit_takes_keys_that_repeat_beyond_it(spark, monkeypatch, top):
    monkeypatch.setattr(rw, "LAST_KEYS", top)
    keys = [*range(60), *[100 + i % 5 for i in range(500)], *[200] * 300]
    table = spark.createDataFrame([(k,) for k in keys], "key long")
    assert rw.cutoff_key(table, 60) == 59 and rw.cutoff_key(table, 900) is None
    rows = spark.createDataFrame([(k, "a@b.co") for k in keys], "id long, email string")
    done = rw.tokenize(rows, ["email"], limit=60, key="id").where("email = 'a@b.co'")
    assert done.count() == len(keys) - 60
    for limit in (100, 700):
        with pytest.raises(rw.RewriteError):
            rw.tokenize(rows, ["email"], limit=limit, key="id").count()
