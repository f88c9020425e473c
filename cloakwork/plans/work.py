"""Running one Spark job per table for a list of tables too long to hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextvars import copy_context
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, Row


def by_dataset(columns: DataFrame) -> Iterator[tuple[Row, list[str]]]:
    """Datasets one after the other, each with its sorted ``column_name``s that are not NULL."""
    rows = columns.orderBy("urn", "column_name").toLocalIterator()
    for _, group in groupby(rows, key=lambda row: row.urn):
        group = list(group)
        yield group[0], [row.column_name for row in group if row.column_name is not None]


def finished(
    run: Callable[[Row, list[str]], Any], work: Iterator[tuple[Row, list[str]]], parallel: int
) -> Iterator[list[Any]]:
    """Results as runs end. A long run holds up no others, and few datasets are held at once."""
    with ThreadPoolExecutor(parallel) as pool:
        running = set()
        for dataset, columns in work:
            running.add(pool.submit(copy_context().run, run, dataset, columns))
            if len(running) >= 2 * parallel:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                yield [task.result() for task in done]
        if running:
            yield [task.result() for task in running]
