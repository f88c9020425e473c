"""The run audit as a folder of few files, with a journal of what has begun.

``audit/cycle=<id>`` holds the rows of a cycle, gathered by count and time before they are written. Of
every 32 folders of one level one of the next level is made, ``cycle=<level>-<id>``, so their number grows
with the logarithm of the history. A note in ``_folds`` says which folders a new one stands for; it
counts as soon as the new one is complete, and a fold cut short is finished or undone by the next.

``audit/_journal/cycle=<id>`` names runs before they begin. A run without an end is recorded as failed
when the next cycle starts, so its dataset stays asked for and is run again; tokens being stable, that
finishes what the first one left. One cycle at a time may use an audit.
"""

from __future__ import annotations

import time
import uuid
from collections import defaultdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..constants import FAILED
from ..operators.runs import AUDIT_SCHEMA
from ..session import local_rows
from .published import Files, literal_path

JOURNAL_SCHEMA = "run_id string, urn string, started_at timestamp, platform string, columns array<string>"
INTERRUPTED_MESSAGE = "The run was interrupted."
#: Folders of one level that become one of the next.
FOLD = 32


class AuditLog:
    """Rows ``AUDIT_SCHEMA`` under ``path``; written after ``most`` rows, or ``seconds`` after the last write."""

    def __init__(self, spark: SparkSession, path: str, *, most: int = 500, seconds: float = 60) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.most, self.seconds = most, seconds
        self.files = Files(spark)
        self._cycle, self._rows, self._last = "", [], time.monotonic()

    # reading

    def rows(self) -> DataFrame:
        """Every run that has ended."""
        names = sorted(self._complete() - self._hidden())
        if not names:
            return local_rows(self.spark, [], AUDIT_SCHEMA)
        return self._read(names)

    def of_cycle(self, cycle: str) -> DataFrame:
        """The runs of one cycle, which has just ended."""
        return self._read([cycle]) if cycle in self._complete() else local_rows(self.spark, [], AUDIT_SCHEMA)

    # writing

    def begin(self, cycle: str, runs: list[tuple]) -> None:
        """Notes runs ``JOURNAL_SCHEMA`` that are about to begin."""
        self._cycle = cycle
        self._append(runs, JOURNAL_SCHEMA, f"{self.path}/_journal/cycle={cycle}")

    def end(self, cycle: str, rows: list[tuple]) -> None:
        """Keeps rows of runs that have ended until there are enough to write."""
        self._cycle = cycle
        self._rows += rows
        if len(self._rows) >= self.most or time.monotonic() - self._last > self.seconds:
            self.flush()

    def flush(self) -> None:
        if self._rows:
            self._append(self._rows, AUDIT_SCHEMA, f"{self.path}/cycle={self._cycle}")
            self._rows = []
        self._last = time.monotonic()

    def close(self, cycle: str) -> None:
        """Ends a cycle: nothing of it is open any more."""
        self.flush()
        self.files.remove(f"{self.path}/_journal/cycle={cycle}")

    def error(self, message: str) -> None:
        """Records that a cycle failed as a whole; the row has no dataset."""
        now = datetime.now(timezone.utc)
        row = (str(uuid.uuid4()), None, now, now, None, [], 0, 0, 0, FAILED, message, None)
        self._append([row], AUDIT_SCHEMA, f"{self.path}/cycle={uuid.uuid4().hex}")

    def recover(self) -> int:
        """Records runs that begun and did not end; returns their number."""
        cycles = self._names(f"{self.path}/_journal", "cycle=")
        found = 0
        for cycle in sorted(cycles):
            begun = self.spark.read.schema(JOURNAL_SCHEMA).parquet(literal_path(f"{self.path}/_journal/cycle={cycle}"))
            # a cycle's rows may have been folded since
            open_ = begun.dropDuplicates(["run_id"]).join(self.rows().select("run_id"), "run_id", "left_anti").collect()
            now = datetime.now(timezone.utc)
            rows = [
                (r.run_id, r.urn, r.started_at, now, r.platform, r.columns, 0, 0, 0, FAILED, INTERRUPTED_MESSAGE, None)
                for r in open_
            ]
            self.end(cycle, rows)
            self.close(cycle)
            found += len(rows)
        return found

    def fold(self) -> None:
        """Makes one folder of many, level by level."""
        for new in self._names(f"{self.path}/_folds", ""):
            self._finish(new)
        levels = defaultdict(list)
        for name in self._complete():
            levels[int(name.split("-")[0]) if "-" in name else 0].append(name)
        for level in sorted(levels):
            if len(levels[level]) >= FOLD:
                new = f"{level + 1}-{uuid.uuid4().hex}"
                old = sorted(levels[level])
                local_rows(self.spark, [(n,) for n in old], "name string").write.parquet(f"{self.path}/_folds/{new}")
                self._read(old).coalesce(1).write.parquet(f"{self.path}/cycle={new}")
                self._finish(new)
                levels[level + 1].append(new)

    def _finish(self, new: str) -> None:
        gone = self._noted(new) if new in self._complete() else [new]
        for name in gone:
            self.files.remove(f"{self.path}/cycle={name}")
        self.files.remove(f"{self.path}/_folds/{new}")

    def _hidden(self) -> set[str]:
        complete = self._complete()
        hidden = set()
        for new in self._names(f"{self.path}/_folds", ""):
            hidden |= set(self._noted(new)) if new in complete else {new}
        return hidden

    def _noted(self, new: str) -> list[str]:
        return [r.name for r in self.spark.read.schema("name string").parquet(f"{self.path}/_folds/{new}").collect()]

    def _complete(self) -> set[str]:
        return self._names(self.path, "cycle=")

    def _names(self, folder: str, prefix: str) -> set[str]:
        """Folders that a job has finished writing."""
        path = self.files.path(f"{literal_path(folder)}/{prefix}*/_SUCCESS")
        found = path.getFileSystem(self.files._conf).globStatus(path) or []
        return {f.getPath().getParent().getName().removeprefix(prefix) for f in found}

    def _read(self, names: list[str]) -> DataFrame:
        places = [literal_path(f"{self.path}/cycle={name}") for name in names]
        return self.spark.read.schema(AUDIT_SCHEMA).parquet(*places)

    def _append(self, rows: list[tuple], schema: str, path: str) -> None:
        local_rows(self.spark, rows, schema).coalesce(1).write.mode("append").parquet(path)

