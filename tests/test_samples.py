"""Mergeable samples of columns against plain Python and against the whole profile."""

import hashlib
import os
import random
from collections import Counter

import pytest

from cloakwork.operators import samples
from cloakwork.operators.detect import Rules, profile_table
from cloakwork.operators.samples import SampleStore, column_samples, merge_samples, sampled_profile

SCHEMA = "id long, mail string, `odd name` string, number long"


def table(n: int, seed: int = 7) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        mail = "hot@example.org" if i % 3 == 0 else f"u{draw.randrange(2 * n)}@example.org"
        rows.append((i, mail if i % 11 else None, draw.choice(["", "x", "ü", "a b"]), draw.randrange(50)))
    return rows


def plain(rows: list[tuple], column: int, k: int) -> set[tuple]:
    counts = Counter(r[column] for r in rows if r[column] is not None)
    hashed = sorted((hashlib.md5(v.encode()).hexdigest(), n) for v, n in counts.items())
    return {*hashed[:k], (None, len(rows))}


def of(sample, name: str) -> set[tuple]:
    return {(r.hash, r.n) for r in sample.where(sample.column_name == name).collect()}


def everything(sample) -> Counter:
    return Counter(map(tuple, sample.collect()))


@pytest.mark.parametrize("n, k", [(3000, 20), (3000, 5000), (40, 10), (1, 1)])
def test_sample_is_the_smallest_hashes(spark, n, k):
    rows = table(n)
    sample = column_samples(spark.createDataFrame(rows, SCHEMA).repartition(5), k=k)
    assert of(sample, "mail") == plain(rows, 1, k) and of(sample, "odd name") == plain(rows, 2, k)


def test_wrong_estimates_change_nothing(spark, monkeypatch):
    rows = table(3000)
    monkeypatch.setattr(samples, "_hash_limit", lambda distinct, k: "00f")
    df = spark.createDataFrame(rows, SCHEMA)
    sample = column_samples(df, k=50)
    assert of(sample, "mail") == plain(rows, 1, 50) and of(sample, "odd name") == plain(rows, 2, 50)
    part, rest = df.where("id < 2000"), df.where("id >= 2000")
    first = column_samples(part, k=50)
    assert everything(merge_samples(first, column_samples(rest, k=50, known=first), k=50)) == everything(sample)


@pytest.mark.parametrize("cuts", [[1500], [0, 10, 11, 2999], [3000]])
def test_merged_parts_are_the_whole(spark, cuts):
    df = spark.createDataFrame(table(3000), SCHEMA)
    whole = column_samples(df, k=25)
    merged = None
    for a, b in zip([0, *cuts], [*cuts, 3000]):
        part = column_samples(df.where(f"id >= {a} AND id < {b}"), k=25, known=merged)
        merged = part if merged is None else merge_samples(merged, part, k=25)
    assert everything(merged) == everything(whole)


def test_profile_from_a_sample(spark):
    df = spark.createDataFrame(table(500), SCHEMA)
    columns = ["mail", "odd name", "number"]
    rules = Rules(validators={"email": r"^\S+@\S+$", "two": r"^\d\d$"})
    whole = profile_table(df, columns, rules)
    assert everything(sampled_profile(column_samples(df, columns, rules)).select(*whole.columns)) == everything(whole)
    empty = sampled_profile(column_samples(df.limit(0), columns, rules)).select(*whole.columns)
    assert everything(empty) == everything(profile_table(df.limit(0), columns, rules))
    assert column_samples(df.select("id"), rules=rules).count() == 0


def test_store_reads_new_files_only(spark, folder):
    path = f"{folder}/t"
    rows = table(900)
    reader = spark.read.schema(SCHEMA)
    store = SampleStore(spark, f"{folder}/samples", k=30, quiet=0)
    assert store.sample("t") is None
    spark.createDataFrame(rows[:600], SCHEMA).coalesce(2).write.parquet(path)
    assert of(store.refresh("t", reader.parquet(path)), "mail") == plain(rows[:600], 1, 30)
    for name in os.listdir(path):  # nothing can be read from the old files any more
        if name.endswith(".parquet"):
            full = f"{path}/{name}"
            times = os.stat(full)
            with open(full, "r+b") as file:
                file.truncate(10)
            os.utime(full, ns=(times.st_atime_ns, times.st_mtime_ns))
    for _ in range(2):  # nothing new
        assert of(store.refresh("t", reader.parquet(path)), "mail") == plain(rows[:600], 1, 30)
    spark.createDataFrame(rows[600:], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert of(store.refresh("t", reader.parquet(path)), "mail") == plain(rows, 1, 30)
    assert of(store.sample("t"), "odd name") == plain(rows, 2, 30)
    assert len(os.listdir(f"{folder}/samples/t")) == 2
    store.forget("t")
    assert store.sample("t") is None


def test_young_files_wait(spark, folder):
    path = f"{folder}/t"
    spark.createDataFrame(table(10), SCHEMA).write.parquet(path)
    store = SampleStore(spark, f"{folder}/samples", quiet=3600)
    assert of(store.refresh("t", spark.read.schema(SCHEMA).parquet(path)), "mail") == {(None, 0)}
