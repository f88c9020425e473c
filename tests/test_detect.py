import pytest
from pyspark.sql import functions as F

from cloakwork.operators import detect as det

FIELD = "urn string, field_path string, tags array<string>"


def fields(spark, rows):
    return spark.createDataFrame([(u, p, t) for u, p, t in rows], FIELD)


def found(spark, rows, *, scope=None, samples=None, rules=None):
    df = fields(spark, rows)
    datasets = df.select("urn").distinct()
    if scope is not None:
        scope = spark.createDataFrame(scope, "urn string, name string")
    profile = None
    if samples is not None:
        long = [("u", c, v) for c, values in samples.items() for v in values]
        frame = spark.createDataFrame(long, "urn string, column_name string, val string")
        profile = det.profile_samples(frame, rules, keys=["urn", "column_name"])
    out = det.detect(datasets, df, scope=scope, profile=profile, rules=rules)
    return {tuple(r) for r in out.collect()}


def columns(*args, **options):
    return {c for _, _, c in found(*args, **options) if c is not None}


# --- one case for each way to be found


def test_one_tagged_field_decides_for_its_dataset(spark):
    rows = [("u", "staff.badge", ["urn:li:tag:owner", "urn:li:tag:sensitive"]), ("u", "staff.home_phone", []),
            ("v", "staff.home_phone", ["urn:li:tag:owner"])]
    assert found(spark, rows) == {("u", "tag", "badge"), ("v", "heuristic", "home_phone")}


def test_a_value_that_matches_confirms_a_name(spark):
    rows = [("u", f"leads.{c}", []) for c in ("work_email", "old_email", "mobile_line", "score")]
    samples = {"work_email": ["?", "kim@mail.test"], "old_email": ["none", ""], "score": ["kim@mail.test"]}
    assert columns(spark, rows, samples=samples) == {"work_email", "mobile_line"}


def test_a_scope_hides_tags_and_names(spark):
    rows = [("u", "orders.note", []), ("u", "orders.ssn", ["urn:li:tag:pii"])]
    assert found(spark, rows, scope=[("u", "note")]) == {("u", "explicit", "note")}


# --- tiers


@pytest.mark.parametrize(
    "names, want",
    [
        (["phone"], {"phone"}),
        (["c.phone", "phone", "ghost"], {"phone"}),
        (["c.city"], {"city"}),
        (["ghost"], set()),
        (["x.phone"], set()),
    ],
)
def test_scope_names(spark, names, want):
    rows = [("u", "c.email", ["urn:li:tag:pii"]), ("u", "c.phone", []), ("u", "c.city", [])]
    got = found(spark, rows, scope=[("u", n) for n in names])
    assert got == {("u", "explicit", c) for c in want or {None}}


def test_empty_scope_is_no_scope(spark):
    rows = [("u", "c.email", []), ("v", "c.email", []), ("v", "c.city", [])]
    got = found(spark, rows, scope=[("u", None), ("v", "city")])
    assert got == {("u", "heuristic", "email"), ("v", "explicit", "city")}


def test_one_tagged_field_suppresses_names_in_its_dataset_only(spark):
    rows = [("u", "c.email", []), ("u", "c.notes", ["urn:li:tag:sensitive"]), ("v", "c.email", [])]
    assert found(spark, rows) == {("u", "tag", "notes"), ("v", "heuristic", "email")}


def test_dataset_without_columns_stays_visible(spark):
    datasets = spark.createDataFrame([("u",), ("empty",)], "urn string")
    out = det.detect(datasets, fields(spark, [("u", "c.city", [])]))
    assert {tuple(r) for r in out.collect()} == {("u", "heuristic", None), ("empty", "heuristic", None)}


def test_paths_with_the_same_leaf_are_one_column(spark):
    rows = [("u", "a.email", []), ("u", "b.email", [])]
    assert [c for _, _, c in sorted(found(spark, rows))] == ["email"]


# --- samples


@pytest.mark.parametrize(
    "column, values, detected",
    [
        ("email", ["x"], False),
        ("email", ["x", "a@b.c"], True),
        ("email", [None, None], False),
        ("email", [None, "a@b.c"], True),
        ("email", [], True),
        ("contact_email", ["bad"], True),  # still named like "contact", which has no validator
        ("ssn", ["bad"], True),
        ("phone_email", ["+1 555 0001"], True),
        ("Phone", ["12345"], False),
        ("Phone", ["1234567\n"], True),
    ],
)
def test_samples(spark, column, values, detected):
    assert (columns(spark, [("u", f"t.{column}", [])], samples={column: values, "other": ["x"]}) == {column}) is detected


def test_samples_of_other_datasets_do_not_count(spark):
    rows = [("u", "t.email", []), ("v", "t.email", [])]
    assert found(spark, rows, samples={"email": ["bad"]}) == {("u", "heuristic", None), ("v", "heuristic", "email")}


def test_profile_of_a_table(spark):
    df = spark.createDataFrame(
        [(1, "a@b.c", True, None), (2, None, False, None)], "id int, mail string, flag boolean, no string"
    )
    rows = {r.column_name: r for r in det.profile_table(df).collect()}
    assert set(rows) == {"mail", "no"}
    assert (rows["mail"].n, rows["mail"].hit_email, rows["mail"].hit_phone) == (2, True, False)
    assert (rows["no"].n, rows["no"].hit_email) == (2, False)
    rules = det.Rules.from_dict({"regex_validators": {"flag": "^True$", "id": r"^\d$"}})
    rows = {r.column_name: r for r in det.profile_table(df, ["flag", "id"], rules).collect()}
    assert rows["flag"].hit_flag and rows["id"].hit_id and not rows["id"].hit_flag


def test_profile_scans_once_and_only_its_columns(spark, small):
    df = det.profile_table(spark.read.parquet(f"{small}/documents.parquet"), ["lang", "source"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<lang:string,source:string>" in plan


# --- rules


def test_rules_fall_back_to_defaults(spark):
    default = det.Rules()
    assert det.Rules.from_dict({}) == default
    assert det.Rules.from_dict({"name_patterns": [], "regex_validators": {}}) == default
    custom = det.Rules.from_dict({"name_patterns": ["City"]})
    assert custom.patterns == ("City",) and custom.validators == default.validators
    assert columns(spark, [("u", "t.CITY_name", []), ("u", "t.email", [])], rules=custom) == {"CITY_name"}


def test_rules_as_a_table(spark):
    rules = det.Rules.from_dict({"name_patterns": ["zip", "iban"], "regex_validators": {"zip": r"^\d{5}$"}})
    assert det.Rules.from_table(rules.table(spark)) == rules
    assert rules.describe() == {"name_patterns": ["zip", "iban"], "regex_validators": ["zip"]}
    assert columns(spark, [("u", "zip", []), ("u", "iban", [])], rules=rules, samples={"zip": ["x"]}) == {"iban"}


def test_validator_is_found_by_the_lower_cased_pattern(spark):
    rules = det.Rules.from_dict({"name_patterns": ["EMAIL"]})
    assert columns(spark, [("u", "email", [])], rules=rules, samples={"email": ["bad"]}) == set()


# --- one dataset with most of the fields, against plain Python


def test_uneven_catalog(spark):
    rows = []
    for i in range(3000):
        urn = "hot" if i % 3 else f"u{i}"
        name = ["email", "city", "ssn", "contact", "amount"][i % 5]
        tag = ["urn:li:tag:pii"] if i % 7 == 0 and urn != "hot" else []
        rows.append((urn, f"t.{name}_{i}", tag))
    want = set()
    for urn in {u for u, _, _ in rows}:
        mine = [(p.split(".")[-1], t) for u, p, t in rows if u == urn]
        tagged = {c for c, t in mine if t}
        named = {c for c, _ in mine if c.startswith(("email", "ssn", "contact"))}
        tier, cols = ("tag", tagged) if tagged else ("heuristic", named)
        want |= {(urn, tier, c) for c in cols or {None}}
    assert found(spark, rows) == want


def test_a_dataset_with_a_third_of_the_fields_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        i = F.col("id")
        urn = F.when(i % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (i / 20).cast("int")))
        df = spark.range(0, 200_000, 1, 8).select(
            urn.alias("urn"), F.concat(F.lit("t.email_"), i).alias("field_path"),
            F.array().cast("array<string>").alias("tags"),
        )
        out = det.detect(df.select("urn").distinct(), df)
        assert len(out.collect()) == 200_000
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "skew=true" in plan and plan.count("Exchange hashpartitioning(urn") >= 1
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_detection_needs_no_python_and_no_nested_loop(spark):
    rows = [("u", "t.email", [])]
    df = fields(spark, rows)
    scope = spark.createDataFrame([("u", "email")], "urn string, name string")
    out = det.detect(df.select("urn").distinct(), df, scope=scope)
    plan = out._jdf.queryExecution().executedPlan().toString()
    for word in ("NestedLoop", "CartesianProduct", "Python"):
        assert word not in plan
