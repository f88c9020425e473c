import base64
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakwork.functions import (
    TokenMode,
    generate_token,
    is_token,
    register_mode,
    register_sql_functions,
    tokenize_if_needed,
    tokenize_many,
)
from cloakwork.functions.tokens import needs_token, token_mode

PYTHON_TOKEN = re.compile(r"^tok_[A-Za-z0-9+/=]+_poc$")
EDGE = [
    None, "", "a", "x" * 58, "x" * 200, "ünï€😀", "tok_YQ==_poc", "tok_YQ==_poc\n",
    "tok_YQ==_poc\r", "tok_YQ==_poc ", "tok_YQ==_poc\n\n", "tok__poc", "tok_hello_poc",
    "TOK_YQ==_POC", "two\nlines", " tok_YQ==_poc", "tok_\n_poc", "tok_a b_poc",
]


def expected(value):
    """token, is_token, tokenize_if_needed of one value."""
    if value is None:
        return None, False, None
    token = "tok_" + base64.b64encode(value.encode()).decode() + "_poc"
    known = bool(PYTHON_TOKEN.match(value))
    return token, known, value if known else token


def columns():
    v = F.col("v")
    return [generate_token(v), is_token(v), tokenize_if_needed(v)]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_edge_values(spark):
    rows = frame(spark, EDGE).select("v", *columns()).collect()
    for value, *got in rows:
        assert tuple(got) == expected(value), repr(value)


def test_line_breaks_do_not_depend_on_the_session(spark):
    for setting in ("true", "false"):
        spark.conf.set("spark.sql.chunkBase64String.enabled", setting)
        try:
            row = frame(spark, ["x" * 500]).select(generate_token(F.col("v"))).first()
        finally:
            spark.conf.unset("spark.sql.chunkBase64String.enabled")
        assert row[0] == expected("x" * 500)[0]


def test_email_is_deterministic_and_recognized(spark):
    row = frame(spark, ["user@example.com"]).select(*columns(), generate_token(F.col("v"))).first()
    assert row[0] == row[3] == "tok_dXNlckBleGFtcGxlLmNvbQ==_poc"
    assert frame(spark, [row[0]]).select(is_token(F.col("v"))).first()[0]


def test_phone_token_stays(spark):
    token = expected("555-1234")[0]
    rows = frame(spark, ["555-1234", token, None]).select(columns()[2]).collect()
    assert [r[0] for r in rows] == [token, token, None]


def test_empty_string_takes_three_runs(spark):
    df = frame(spark, [""])
    seen = []
    for _ in range(3):
        df = df.select(tokenize_if_needed(F.col("v")).alias("v"))
        seen.append(df.first()[0])
    assert seen == ["tok__poc", "tok_dG9rX19wb2M=_poc", "tok_dG9rX19wb2M=_poc"]


def test_empty_string_can_be_skipped(spark):
    v = F.col("v")
    row = frame(spark, [""]).select(
        tokenize_if_needed(v, skip_empty=True), needs_token(v, skip_empty=True)
    ).first()
    assert tuple(row) == ("", False)


def test_arrays_are_encoded_without_the_token_check(spark):
    df = spark.createDataFrame([(["a", "tok_YQ==_poc", None],)], "v array<string>")
    assert df.select(tokenize_many(F.col("v"))).first()[0] == [
        expected("a")[0], expected("tok_YQ==_poc")[0], None,
    ]


def test_documents_equal_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("text").alias("v"))
    for value, *got in docs.select("v", *columns()).collect():
        assert tuple(got) == expected(value)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=120), min_size=1))
def test_any_text_equals_python_and_is_stable(spark, values):
    df = frame(spark, values).select("v", *columns())
    for value, *got in df.collect():
        assert tuple(got) == expected(value)
    once = frame(spark, [v for v in values if v]).select(tokenize_if_needed(F.col("v")).alias("v"))
    assert once.where(needs_token(F.col("v"))).count() == 0


def test_sql_functions(spark):
    register_sql_functions(spark)
    df = frame(spark, EDGE).selectExpr(
        "v", "generate_token(v)", "is_token(v)", "tokenize_if_needed(v)", "tokenize_many(array(v))"
    )
    for value, token, known, needed, many in df.collect():
        assert (token, known, needed) == expected(value)
        assert many == [token]
    assert "Python" not in df._jdf.queryExecution().toString()


def test_modes(spark):
    with pytest.raises(NotImplementedError):
        token_mode("vault")
    register_mode(TokenMode("reversed", lambda v: F.concat(F.lit("tok_"), F.reverse(v), F.lit("_poc"))))
    rows = frame(spark, ["abc", "tok_x_poc", None]).select(tokenize_if_needed(F.col("v"), "reversed"))
    assert [r[0] for r in rows.collect()] == ["tok_cba_poc", "tok_x_poc", None]


def test_mode_with_pandas_udf(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def outside(values: pd.Series) -> pd.Series:
        return "tok_" + values.str.upper() + "_poc"

    mode = TokenMode("outside", outside)
    rows = frame(spark, ["abc", "tok_x_poc"]).select(tokenize_if_needed(F.col("v"), mode)).collect()
    assert [r[0] for r in rows] == ["tok_ABC_poc", "tok_x_poc"]
