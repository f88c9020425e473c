"""Column expressions. All run inside the JVM; none is a Python UDF."""

from .names import (
    add_and_remove,
    csv,
    dataset_ref,
    dataset_urn,
    has_pii_tag,
    leaf_column,
    table_expression,
    tag_urns,
    urn_problem,
)
from .patterns import matches, spark_pattern
from .sql import register_sql_functions
from .status import (
    iso_timestamp,
    outcome,
    parse_status,
    status_json,
    success_message,
    upsert_property,
)
from .tokens import (
    TokenMode,
    any_needs_token,
    generate_token,
    is_token,
    needs_token,
    register_mode,
    token_mode,
    tokenize_if_needed,
    tokenize_many,
)

__all__ = [
    "TokenMode",
    "add_and_remove",
    "any_needs_token",
    "csv",
    "dataset_ref",
    "dataset_urn",
    "generate_token",
    "has_pii_tag",
    "is_token",
    "iso_timestamp",
    "leaf_column",
    "matches",
    "needs_token",
    "outcome",
    "parse_status",
    "register_mode",
    "register_sql_functions",
    "spark_pattern",
    "status_json",
    "success_message",
    "table_expression",
    "tag_urns",
    "token_mode",
    "tokenize_if_needed",
    "tokenize_many",
    "upsert_property",
    "urn_problem",
]
