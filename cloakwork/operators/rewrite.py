"""Tokenizing the columns of a table.

Without a limit the whole rewrite is one projection: no shuffle, no join, and every row is handled
where it was read. With a limit the first n candidates are found as a cut-off key, which then is a
literal in that same projection.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..functions.tokens import TokenMode, any_needs_token, needs_token, tokenize_if_needed
from ..session import stored

# Keys that one task sorts to find a cut-off; while more are left, their range is narrowed by counting.
LAST_KEYS = 10_000
_PIVOTS = 64


class RewriteError(ValueError):
    """The table cannot be rewritten as asked. The message never holds cell values."""


def column(name: str) -> Column:
    """Column by its exact name."""
    return F.col(quoted(name))


def check_columns(df: DataFrame, columns: list[str], *, cast_non_string: bool = False) -> None:
    """Raise unless every target exists under exactly this name and holds strings."""
    types = {field.name: field.dataType for field in df.schema.fields}
    missing = [name for name in columns if name not in types]
    if missing:
        raise RewriteError(f"No such column: {', '.join(missing)}")
    other = [name for name in columns if not isinstance(types[name], T.StringType)]
    if other and not cast_non_string:
        found = ", ".join(f"{name} is {types[name].simpleString()}" for name in other)
        raise RewriteError(f"Only string columns can be tokenized: {found}")


def candidates(
    df: DataFrame,
    columns: list[str],
    *,
    key: str = "id",
    mode: str | TokenMode = "dummy",
    skip_empty: bool = False,
) -> DataFrame:
    """Key and target columns of the rows with at least one plaintext cell."""
    targets = [column(name) for name in columns]
    guard = any_needs_token(targets, mode, skip_empty=skip_empty)
    return df.where(guard).select(column(key), *targets)


def first_candidates(found: DataFrame, limit: int, *, key: str = "id") -> tuple[Column, int]:
    """Condition on the table that holds for no candidates but the first ``limit`` in key order,
    and the number of candidates beyond them.

    Raises if these candidates are not determined by their keys: a NULL key, or a key that occurs
    twice among them.
    """
    if limit < 0:
        raise RewriteError("A limit cannot be negative")
    if limit == 0:
        return F.lit(False), found.count()
    keys = stored(found.select(column(key).alias("key")), "candidate-keys")
    last = cutoff_key(keys.where("key IS NOT NULL"), limit)
    picked = F.lit(True) if last is None else F.col("key") <= F.lit(last)
    total, nulls, rows, distinct = keys.agg(
        F.count("*"),
        F.count_if(F.col("key").isNull()),
        F.count_if(picked & F.col("key").isNotNull()),
        F.count_distinct(F.when(picked, F.col("key"))),
    ).first()
    if nulls or rows != distinct:
        raise RewriteError(f"A limit needs unique keys that are not NULL in column {key}")
    within = F.lit(True) if last is None else F.coalesce(column(key) <= F.lit(last), F.lit(False))
    return within, total - rows


def cutoff_key(keys: DataFrame, n: int) -> Any:
    """The n-th smallest value of column ``key``, None if there are fewer.

    The range that holds it is narrowed until what is left fits one task, whatever n is. A round takes up
    to 64 keys of the range as pivots, those with the smallest hash in their bucket, which tasks find and
    Spark merges, and counts the keys between them. Any pivots give the exact answer; copies of a key
    count as one for the pivots, so a frequent key does not slow the narrowing down.
    """
    left = keys.count()
    if left < n:
        return None
    part, n = narrowed(keys, n, left)
    return part.orderBy("key").limit(n).agg(F.max("key")).first()[0]


def narrowed(keys: DataFrame, n: int, left: int) -> tuple[DataFrame, int]:
    """Part of ``left`` keys that holds the n-th smallest, and its rank there.

    The part has at most ``LAST_KEYS`` rows, or copies of a single key.
    """
    turn = 0
    while left > LAST_KEYS:
        turn += 1
        chosen = keys.groupBy(F.pmod(F.hash("key", F.lit(turn)), F.lit(_PIVOTS)).alias("bucket"))
        found = chosen.agg(F.min_by("key", F.xxhash64("key", F.lit(turn))).alias("key")).select("key").collect()
        pivots = sorted(row.key for row in found)
        if len(pivots) == 1 and keys.where(F.col("key") != F.lit(pivots[0])).isEmpty():
            return keys.limit(1), 1
        above = sum((F.col("key") > F.lit(p)).cast("int") for p in pivots)
        counts = dict(keys.groupBy(above.alias("range")).count().collect())
        number = 0
        while n > counts.get(number, 0):
            n -= counts.get(number, 0)
            number += 1
        left = counts[number]
        if number > 0:
            keys = keys.where(F.col("key") > F.lit(pivots[number - 1]))
        if number < len(pivots):
            keys = keys.where(F.col("key") <= F.lit(pivots[number]))
    return keys, n


def tokenize(
    df: DataFrame,
    columns: list[str],
    *,
    limit: int | None = None,
    key: str = "id",
    mode: str | TokenMode = "dummy",
    skip_empty: bool = False,
    cast_non_string: bool = False,
) -> DataFrame:
    """The table with plaintext cells of the target columns replaced by tokens.

    All rows and all other columns are kept. ``limit`` changes only the first ``limit`` candidate
    rows by key; finding them runs jobs at once. ``skip_empty`` leaves empty strings alone, which
    otherwise get a token that the next run encodes once more.
    """
    check_columns(df, columns, cast_non_string=cast_non_string)
    within = None
    if limit is not None:
        found = candidates(df, columns, key=key, mode=mode, skip_empty=skip_empty)
        within, _ = first_candidates(found, limit, key=key)
    return rewrite(df, columns, within=within, mode=mode, skip_empty=skip_empty)


def rewrite(
    df: DataFrame,
    columns: list[str],
    *,
    within: Column | None = None,
    mode: str | TokenMode = "dummy",
    skip_empty: bool = False,
) -> DataFrame:
    """Projection behind :func:`tokenize`; rows outside ``within`` stay as they are."""
    string = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}

    def cell(name: str) -> Column:
        value = column(name) if name in string else column(name).cast("string")
        new = tokenize_if_needed(value, mode, skip_empty=skip_empty)
        if within is not None:
            new = F.when(within, new).otherwise(value)
        return new.alias(name)

    targets = set(columns)
    return df.select(*[cell(c) if c in targets else column(c) for c in df.columns])


def metrics(
    columns: list[str],
    *,
    within: Column | None = None,
    mode: str | TokenMode = "dummy",
    skip_empty: bool = False,
) -> list[Column]:
    """Counters over the table *before* the rewrite, as aggregate Columns.

    ``rows_skipped`` counts rows fetched for a change that needed none. One guard decides both
    here, so it is always 0.
    """
    targets = [column(name) for name in columns]
    within = F.lit(True) if within is None else within
    row = any_needs_token(targets, mode, skip_empty=skip_empty)
    cells = [needs_token(t, mode, skip_empty=skip_empty).cast("bigint") for t in targets]
    cell_count = sum(cells) if cells else F.lit(0).cast("bigint")
    changed = F.count_if(row & within)
    return [
        F.count(F.lit(1)).alias("rows_scanned"),
        changed.alias("rows_updated"),
        F.lit(0).cast("bigint").alias("rows_skipped"),
        F.count_if(~row).alias("rows_clean"),
        F.coalesce(F.sum(F.when(within, cell_count)), F.lit(0)).alias("cells_updated"),
        F.count_if(row & ~within).alias("rows_remaining"),
    ]


def run_metrics(df: DataFrame, columns: list[str], **options: Any) -> DataFrame:
    """The counters of :func:`metrics` as a one-row DataFrame, in one pass."""
    return df.agg(*metrics(columns, **options))


def remaining_plaintext(
    df: DataFrame, columns: list[str], *, mode: str | TokenMode = "dummy"
) -> DataFrame:
    """Number of plaintext cells per target column, in one pass."""
    counts = df.agg(*[F.count_if(needs_token(column(c), mode)).alias(c) for c in columns])
    return counts.unpivot([], [quoted(c) for c in columns], "column_name", "remaining")


def idempotency_report(
    df: DataFrame, columns: list[str], *, passes: int = 2, mode: str | TokenMode = "dummy"
) -> DataFrame:
    """Rows each of several successive runs would change: all passes in one scan.

    A second run that changes rows means values whose token is not recognized as one; with the
    built-in mode these are empty strings.
    """
    state = df.select(*[column(c).alias(f"c{i}") for i, c in enumerate(columns)])
    names = state.columns
    flags: list[str] = []
    for number in range(1, passes + 1):
        flag = f"pass_{number}"
        changed = any_needs_token([F.col(n) for n in names], mode)
        state = state.select(
            *flags,
            changed.alias(flag),
            *[tokenize_if_needed(F.col(n), mode).alias(n) for n in names],
        )
        flags.append(flag)
    counts = state.agg(*[F.count_if(F.col(f)).alias(f) for f in flags])
    report = counts.unpivot([], flags, "pass_name", "rows_updated")
    number = F.substring_index("pass_name", "_", -1).cast("int")
    return report.select(number.alias("pass_no"), "rows_updated")
