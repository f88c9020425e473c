"""Views over the run audit, an append-only table with one row per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import STATUS_PROPERTY
from ..functions.status import outcome, status_json, upsert_property

AUDIT_SCHEMA = (
    "run_id string, urn string, started_at timestamp, ended_at timestamp, platform string, "
    "columns array<string>, rows_updated bigint, rows_skipped bigint, rows_remaining bigint, "
    "status string, message string, output string"
)


def latest_runs(audit: DataFrame, *, order: list[str] | None = None) -> DataFrame:
    """Last run of every dataset, by end time and run id unless another order is given.

    Nothing but one row per dataset leaves a task.
    """
    by = order or ["ended_at", "run_id"]
    rest = [c for c in audit.columns if c != "urn"]
    last = F.max_by(F.struct(*rest), F.struct(*by))
    return audit.where("urn IS NOT NULL").groupBy("urn").agg(last.alias("last")).select("urn", "last.*")


def run_outcomes(asked: DataFrame, runs: DataFrame, *, on: list[str] | None = None) -> DataFrame:
    """``done``, ``failed`` or ``waiting`` for every dataset asked about.

    ``runs`` are the latest runs. With ``on=["urn", "run_id"]`` they may be the whole audit, and
    only the run asked about counts, not an earlier one.
    """
    keys = on or ["urn"]
    return asked.join(runs.select(*keys, "status"), keys, "left").select(
        *keys, outcome(F.col("status")).alias("outcome")
    )


def current_outputs(audit: DataFrame) -> DataFrame:
    """Where the current version of each rewritten table is: ``urn, output``."""
    return latest_runs(audit.where(F.col("output").isNotNull())).select("urn", "output")


def record_runs(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Catalog datasets with the status of their run, failed ones too, among their ``properties``.

    ``runs`` has at most one row for each dataset; others keep the status of an earlier run.
    """
    names = [c for c in runs.columns if c != "urn"]
    one = runs.where("urn IS NOT NULL").select("urn", *[F.col(c).alias(f"_run_{c}") for c in names])
    recorded = upsert_property(F.col("properties"), STATUS_PROPERTY, status_json("_run_"))
    new = F.when(F.col("_run_run_id").isNull(), F.col("properties")).otherwise(recorded)
    return datasets.join(one, "urn", "left").withColumn("properties", new).select(*datasets.columns)


def with_status_property(df: DataFrame, properties: Column) -> DataFrame:
    """Run rows with the dataset's property map, the run's status recorded in it."""
    recorded = upsert_property(properties, STATUS_PROPERTY, status_json())
    return df.withColumn("properties", recorded)
