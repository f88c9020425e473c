"""Compare registered queries with their SQL.

    python -m verification.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from cloakwork.session import local_session

from .fixtures import TABLES
from .oracles import oracle_sql
from .queries import QUERIES


def duckdb_over(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normalized(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of plain values, columns in name order."""
    names = sorted(frame.columns)
    rows = frame[names].astype(object).where(frame[names].notna(), None)
    return sorted(map(tuple, rows.itertuples(index=False)), key=repr)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def difference(
    spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str
) -> str | None:
    """What differs between the two results; None if nothing does."""
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = con.execute(oracle_sql()[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) and kinds(ours) != kinds(theirs):
        return f"types {kinds(ours)} / {kinds(theirs)}"
    left, right = normalized(ours), normalized(theirs)
    if left != right:
        pairs = [(a, b) for a, b in zip(left, right) if a != b][:2]
        return f"rows {len(left)} / {len(right)}; first differences {str(pairs)[:600]}"
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_over(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, con, name, sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
