"""The token functions under SQL names.

They are SQL functions with an expression body, so Catalyst inlines them: no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..constants import TOKEN_PATTERN, TOKEN_PREFIX, TOKEN_SUFFIX
from .patterns import spark_pattern

_TOKEN = (
    f"concat('{TOKEN_PREFIX}', replace(base64(cast(%s AS binary)), '\\r\\n', ''), '{TOKEN_SUFFIX}')"
)
_IS_TOKEN = (
    f"coalesce(startswith(value, '{TOKEN_PREFIX}') "
    f"AND rlike(value, r'{spark_pattern(TOKEN_PATTERN)}'), false)"
)

_FUNCTIONS = {
    "generate_token(value STRING) RETURNS STRING": _TOKEN % "value",
    "is_token(value STRING) RETURNS BOOLEAN": _IS_TOKEN,
    "tokenize_if_needed(value STRING) RETURNS STRING": (
        f"CASE WHEN value IS NULL OR {_IS_TOKEN} THEN value ELSE {_TOKEN % 'value'} END"
    ),
    "tokenize_many(items ARRAY<STRING>) RETURNS ARRAY<STRING>": (
        f"transform(items, item -> {_TOKEN % 'item'})"
    ),
}


def register_sql_functions(spark: SparkSession) -> None:
    """Create ``generate_token``, ``is_token``, ``tokenize_if_needed``, ``tokenize_many``."""
    for signature, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
