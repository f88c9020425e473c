"""Run status as Column expressions: message, JSON, timestamps, outcome, property map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FAILED, NO_COLUMNS_MESSAGE, STATUS_PROPERTY, SUCCESS, SUCCESS_MESSAGE

STATUS_SCHEMA = (
    "run_id string, started_at string, ended_at string, platform string, columns array<string>, "
    "rows_updated bigint, rows_skipped bigint, status string, message string"
)


def iso_timestamp(value: Column) -> Column:
    """ISO text of a timestamp in UTC, without zone; microseconds only where there are any.

    A timestamp without time zone is taken to be in UTC, whatever the session's zone.
    """
    local = value.cast("timestamp_ntz")
    utc = F.when(
        F.typeof(value) == "timestamp", F.convert_timezone(None, F.lit("UTC"), local)
    ).otherwise(local)
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(utc, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def success_message(columns: Column, rows_updated: Column, rows_skipped: Column) -> Column:
    return F.when(F.size(columns) == 0, F.lit(NO_COLUMNS_MESSAGE)).otherwise(
        F.format_string(
            SUCCESS_MESSAGE, F.array_join(columns, ", "), rows_updated, rows_skipped
        )
    )


def status_json(prefix: str = "") -> Column:
    """Status row (``STATUS_SCHEMA``, timestamps as such) as JSON text, NULLs written out.

    The columns of the row may carry a ``prefix``.
    """

    def cell(name: str) -> Column:
        value = F.col(prefix + name)
        return (iso_timestamp(value) if name in ("started_at", "ended_at") else value).alias(name)

    names = [field.split()[0] for field in STATUS_SCHEMA.split(", ")]
    return F.to_json(F.struct(*map(cell, names)), {"ignoreNullFields": "false"})


def upsert_property(properties: Column, key: str, value: Column) -> Column:
    """Property map with one entry set; the others are kept and written as text."""
    kept = F.map_filter(properties, lambda k, _: k != key)
    texts = F.transform_values(kept, lambda _, v: v.cast("string"))
    empty = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")
    )
    return F.map_concat(F.coalesce(texts, empty), F.create_map(F.lit(key), value))


def parse_status(properties: Column) -> Column:
    """Struct of the last run written in a property map; NULL where there is none."""
    return F.from_json(F.try_element_at(properties, F.lit(STATUS_PROPERTY)), STATUS_SCHEMA)


def outcome(status: Column) -> Column:
    """``done``, ``failed``, ``waiting`` (no status yet) or ``unknown``."""
    return (
        F.when(status.isNull(), F.lit("waiting"))
        .when(status == SUCCESS, F.lit("done"))
        .when(status == FAILED, F.lit("failed"))
        .otherwise(F.lit("unknown"))
    )
