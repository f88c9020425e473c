import re
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakwork.constants import DATASET_URN_PATTERN, TOKEN_PATTERN, VALIDATORS
from cloakwork.functions import matches, spark_pattern

SPACES = [chr(c) for c in range(sys.maxunicode + 1) if re.match(r"\s", chr(c))]
ENDINGS = ["", "\n", "\r", "\r\n", "\n\n", " ", "\u0085", " "]
TEXTS = (
    [f"a@b.c{e}" for e in ENDINGS]
    + [f"+1 (555)-0001{e}" for e in ENDINGS]
    + [f"a{s}b@c.d" for s in SPACES]
    + [f"555{s}1234" for s in SPACES]
    + ["", "x", "a@b", "a@@b.c", "123456", "1234567", "١٢٣", "é_9", "$5", "a$", "ab", "xab"]
)
PATTERNS = [
    *VALIDATORS.values(), TOKEN_PATTERN, DATASET_URN_PATTERN, r"\d+$", r"\w+$", r"\S+$", r"[^\s]+",
    r"a\$", r"[$]5", r"a|b$", r"ab", r"", r"\W", r"\D+",
    r"(?P<first_name>a)(?P<b>\W)?(?P=first_name)?", r"a{x}|{", "\U0001F600|é_", r"(a)(.)b\2", r"\bab\b", r".*\B", r"\B",
    r"[^\W\d]+", r"[\W\d]+$", r"[^\S\n]", r"[\D\S]", r"(?s).*$", r"(?m)a$|^x", r"(?a)\w+$", r"(?x) a  # comment", r"(?s:.)b",
    r"(?>a|ab)c?", r"a*+b", r"(?=a)\w", r"(?!a)[a-z]@", r"x(?<=x)ab", r"(?:a|b){1,2}?@", r"[-^\]a&]+@", r"(|a)+b", r"[\x00-\x1f]",
    r"a.b", r".+\Z", r"(a$|555.*$)", r"[[]|x", r"(?P<n>a)@", r"5{,2}1?", r"[a&&b]+@", r"[]a]", r"[^]a]",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_answer_as_python(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "v string")
    for text, got in df.select("v", matches(F.col("v"), pattern)).collect():
        assert got == bool(re.match(pattern, text)), (pattern, text)


@pytest.mark.parametrize("pattern", [r"(?i)a", r"(a)(?(1)b|c)", r"(?i:a)b", r"a{3000000000}", "("])
def test_what_cannot_be_expressed_is_refused(pattern):
    with pytest.raises((ValueError, re.error)):
        spark_pattern(pattern)


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(matches(F.col("v"), "a")).first()[0] is None


def test_dollar():
    assert spark_pattern("a$b|c") == r"\A(?:(?:a(?=\n?\z)b|c))"
    assert spark_pattern("a$") == r"\A(?:a\n?\z)"
    assert spark_pattern(r"a\$") == r"\A(?:a\$)"
    assert spark_pattern("[$]") == r"\A(?:\$)" and spark_pattern("[$a]") == r"\A(?:[$a])"


PARTS = st.sampled_from(
    ["a", "b", "1", "_", " ", "é", "😀", r"\d", r"\w", r"\s", r"\W", r"\S", r"\D", ".", "^", "$", r"\b", r"\B", r"\Z", "[ab]", "[^a1]",
     r"[\wé]", r"[^\s\d]", r"[\W_]", r"[a\S]", r"[^\Wa]", r"[]-]", r"\.", r"\$", "{", "}", "-", "&&", "~"]
)
REGEXES = st.recursive(
    PARTS,
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=3).map("".join),
        st.tuples(inner, inner).map(lambda p: f"(?:{p[0]}|{p[1]})"),
        st.tuples(inner, st.sampled_from(["*", "+", "?", "{1,2}", "*?", "{,2}", "?+"])).map(lambda p: f"(?:{p[0]}){p[1]}"),
        inner.map(lambda p: f"({p})"),
        inner.map(lambda p: f"(?P<n{abs(hash(p))}>{p})"),
        st.tuples(st.sampled_from(["(?=%s)", "(?!%s)", "(?>%s)"]), inner).map(lambda p: p[0] % p[1]),
    ),
    max_leaves=6,
)


@settings(max_examples=600, deadline=None, suppress_health_check=list(HealthCheck))
@given(REGEXES, st.lists(st.text("ab1_ é😀\n\r.$-&{}~", max_size=6), min_size=5, max_size=5))
def test_random_patterns_give_the_same_answer(spark, pattern, texts):
    try:
        re.compile(pattern)
    except re.error:
        return
    compiled = spark._jvm.java.util.regex.Pattern.compile(spark_pattern(pattern))
    for text in texts:
        assert compiled.matcher(text).find() == bool(re.match(pattern, text)), (pattern, spark_pattern(pattern), text)


@settings(max_examples=500, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text("ab(|)[]{}^$.*+?\\\\dswbB1,-&<>=!:P", max_size=10))
def test_what_is_accepted_compiles(spark, pattern):
    try:
        ours = spark_pattern(pattern)
    except (ValueError, re.error, OverflowError):
        return
    spark._jvm.java.util.regex.Pattern.compile(ours)
