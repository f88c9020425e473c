"""One cycle of the product path: requests -> target columns -> rewritten tables -> audit -> tags.

What is decided per dataset is computed for the whole catalog in one plan and written. The driver
then walks that list (names only, never table data) and starts one Spark job per table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import islice
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..constants import FAILED, NO_COLUMNS_MESSAGE, SUCCESS, SUCCESS_MESSAGE
from ..functions.tokens import TokenMode, any_needs_token, token_mode
from ..operators.catalog import Catalog, run_requests, split_urns
from ..operators.detect import Rules, detect, heuristic_columns, profile_schema, profile_table
from ..operators.rewrite import (
    RewriteError,
    candidates,
    check_columns,
    column,
    first_candidates,
    metrics,
    rewrite,
)
from ..operators.runs import current_outputs, record_runs
from ..operators.tags import apply_outcomes
from ..session import local_rows, stored, workspace
from ..sources.audit import AuditLog
from ..sources.tables import Rewrite, Tables, UnsupportedPlatform, tables_of
from .work import by_dataset, finished


#: Runs that are noted by one file before they begin. The next ones wait for the last of them.
JOURNAL_WAVE = 500


@dataclass(frozen=True)
class RunConfig:
    """How runs are done. ``limit=None`` rewrites whole tables.

    ``check_values`` looks into the tables before names alone decide: columns named like one of
    the rules' validators are read, and count only if some value matches.
    """

    platforms: dict[str, Tables]
    audit: str
    limit: int | None = None
    key: str = "id"
    mode: str | TokenMode = "dummy"
    rules: Rules = field(default_factory=Rules)
    skip_empty: bool = False
    check_values: bool = False
    parallel_tables: int = 4


@dataclass(frozen=True)
class CycleResult:
    cycle: str
    targets: DataFrame
    audit: DataFrame
    catalog: Catalog
    rejected: DataFrame


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table of this library, made empty where it does not exist yet."""
    local_rows(spark, [], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def decide(
    spark: SparkSession, catalog: Catalog, config: RunConfig, profile: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Written decisions ``urn, ref, output, tier, column_name``; and datasets with a bad URN."""
    usable, rejected = split_urns(catalog.datasets)
    requests = stored(run_requests(usable, catalog.fields), "requests")
    asked = requests.select("urn").distinct()
    fields = catalog.fields.join(asked, "urn", "left_semi")
    outputs = current_outputs(AuditLog(spark, config.audit).rows())
    places = usable.select("urn", "ref").join(outputs, "urn", "left")
    if config.check_values and profile is None:
        profile = profile_datasets(spark, fields, places, config)
    targets = detect(
        asked,
        fields,
        scope=requests.select("urn", F.col("field_path").alias("name")),
        profile=profile,
        rules=config.rules,
    )
    return stored(targets.join(places, "urn"), "decisions"), rejected


def profile_datasets(
    spark: SparkSession, fields: DataFrame, places: DataFrame, config: RunConfig
) -> DataFrame:
    """Written profile ``urn, column_name, n, hit_*`` of the columns whose values matter.

    One scan per table, of these columns only. A table that cannot be read has no profile; its run
    will say why.
    """
    rules = config.rules
    schema = "urn string, " + profile_schema(rules)
    checked = Rules(tuple(p for p, v in rules.pairs() if v), rules.validators)
    if not checked.patterns:
        return local_rows(spark, [], schema)
    path = workspace(spark, "profile")  # a folder for each table, as jobs that run together must not share one
    found = read_table(spark, f"{path}/table-none", schema)

    def run(dataset: Row, columns: list[str]) -> None:
        try:
            table = tables_of(config.platforms, dataset.ref.platform)
            df = table.read(spark, dataset.ref, dataset.output)
            known = [c for c in columns if c in df.columns]
            if known:
                rows = profile_table(df, known, rules).withColumn("urn", F.lit(dataset.urn))
                rows.select(*found.columns).write.parquet(f"{path}/table-{uuid.uuid4().hex}")
        except (UnsupportedPlatform, PySparkException, Py4JJavaError):
            return

    work = by_dataset(heuristic_columns(fields, checked).join(places, "urn"))
    for _ in finished(run, work, config.parallel_tables):
        pass
    return spark.read.schema(schema).parquet(f"{path}/table-*")


def run_cycle(
    spark: SparkSession, catalog: Catalog, config: RunConfig, *, profile: DataFrame | None = None
) -> CycleResult:
    """Run everything the catalog asks for. A dataset that fails does not stop the others.

    Runs that an earlier cycle has begun and not ended are recorded first. The catalog of the result has
    the tags after the runs, and every run's status among its dataset's properties.
    """
    cycle = uuid.uuid4().hex
    log = AuditLog(spark, config.audit)
    log.recover()
    decisions, rejected = decide(spark, catalog, config, profile)
    work = by_dataset(decisions)
    while wave := [(str(uuid.uuid4()), *one) for one in islice(work, JOURNAL_WAVE)]:
        now = datetime.now(timezone.utc)
        log.begin(cycle, [(run_id, d.urn, now, d.ref.platform, columns) for run_id, d, columns in wave])
        ids = {dataset.urn: run_id for run_id, dataset, _ in wave}

        def run(dataset: Row, columns: list[str]) -> tuple:
            return run_table(spark, config, dataset, columns, run_id=ids[dataset.urn])

        for rows in finished(run, ((dataset, columns) for _, dataset, columns in wave), config.parallel_tables):
            log.end(cycle, rows)
    log.close(cycle)
    audit = log.of_cycle(cycle)
    targets = decisions.select("urn", "column_name")
    after = apply_outcomes(catalog, audit.select("urn", "status"), targets)
    if "properties" in after.datasets.columns:
        after = Catalog(record_runs(after.datasets, audit), after.fields)
    return CycleResult(cycle, targets, audit, after, rejected)


def run_table(
    spark: SparkSession, config: RunConfig, dataset: Row, columns: list[str], *, run_id: str | None = None
) -> tuple:
    """Run one dataset and return its audit row."""
    run_id = run_id or str(uuid.uuid4())
    started = datetime.now(timezone.utc)
    counts = {"rows_updated": 0, "rows_skipped": 0, "rows_remaining": 0}
    output = None
    try:
        if columns:
            counts, output = _rewrite_table(spark, dataset, columns, config, run_id)
        status, message = SUCCESS, _message(columns, counts)
    except Exception as error:
        status, message = FAILED, safe_message(error)
    return (
        run_id,
        dataset.urn,
        started,
        datetime.now(timezone.utc),
        dataset.ref.platform,
        columns,
        counts["rows_updated"],
        counts["rows_skipped"],
        counts["rows_remaining"],
        status,
        message,
        output,
    )


def _rewrite_table(
    spark: SparkSession, dataset: Row, columns: list[str], config: RunConfig, run_id: str
) -> tuple[dict[str, int], str | None]:
    tables = tables_of(config.platforms, dataset.ref.platform)
    options: dict[str, Any] = {
        "mode": token_mode(config.mode),
        "skip_empty": config.skip_empty,
    }
    df = tables.read(spark, dataset.ref, dataset.output)
    check_columns(df, columns)
    found = candidates(df, columns, key=config.key, **options)
    if found.isEmpty():  # nothing to change: read the target columns, write nothing
        return {"rows_updated": 0, "rows_skipped": 0, "rows_remaining": 0}, None
    changed = any_needs_token([column(name) for name in columns], **options)
    remaining = 0
    if config.limit is not None:
        within, remaining = first_candidates(found, config.limit, key=config.key)
        options["within"] = within
        changed = changed & within
    counters: list[Observation] = []

    def after(rows: DataFrame) -> DataFrame:
        counters.append(Observation())
        return rewrite(rows.observe(counters[-1], *metrics(columns, **options)), columns, **options)

    output = tables.write(
        Rewrite(dataset.ref, run_id, df, changed, after, [config.key, *columns], config.limit is not None)
    )
    counts = {"rows_updated": 0, "rows_skipped": 0, "rows_remaining": remaining}
    for counter in counters:
        for name in ("rows_updated", "rows_skipped"):
            counts[name] += counter.get[name] or 0
    return counts, output


def _message(columns: list[str], counts: dict[str, int]) -> str:
    if not columns:
        return NO_COLUMNS_MESSAGE
    return SUCCESS_MESSAGE % (", ".join(columns), counts["rows_updated"], counts["rows_skipped"])


def safe_message(error: Exception) -> str:
    """Text for the audit. Messages of Spark errors may quote cell values, so only their kind."""
    if isinstance(error, (RewriteError, UnsupportedPlatform, NotImplementedError)):
        return str(error)
    if isinstance(error, PySparkException) and error.getCondition():
        return f"{type(error).__name__}: {error.getCondition()}"
    if isinstance(error, Py4JJavaError):
        return f"{type(error).__name__}: {error.java_exception.getClass().getName()}"
    return type(error).__name__
