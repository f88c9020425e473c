"""Totals of tokens by source, language and tokenizer version, kept up to date by batches of changes.

A change inserts a document's count, deletes it, or revises it (the old count goes, the new one
comes, perhaps under another source, language or version). A batch of changes becomes signed sums per
key; totals are the sums of all batches. A commit is a folder with the new totals and the id of its
batch. It is written under a name of its own and then takes the next number, which only one writer can;
another one starts again from the commit it has lost to, so several may write at once. A batch whose id
is in some commit changes nothing, so a batch may be sent again after any failure. Every 64 commits the
ids so far are written together.

NULL source, language and version are keys of their own; a NULL count is 0 tokens; a NULL batch id is
an error. Totals of a key whose documents have all gone are left out. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_rows
from .common import column

KEYS = ["source", "lang", "version"]
#: Commits after which their batches' ids are written together.
TOGETHER = 64
_TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"


def inserts(rows: DataFrame) -> DataFrame:
    """Changes that add documents ``source, lang, version, tokens``."""
    return _signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    """Changes that take documents away, with the keys and counts they were added by."""
    return _signed(rows, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace documents' counts or keys."""
    return _signed(old, -1).unionByName(_signed(new, 1))


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    tokens = F.coalesce(column("tokens").cast("long"), F.lit(0)) * sign
    keys = [column(k).cast("string").alias(k) for k in KEYS]
    return rows.select(*keys, F.lit(sign).cast("long").alias("n_docs"), tokens.alias("n_tokens"))


@dataclass(frozen=True)
class TokenTotals:
    """Totals in ``path``, a folder that all executors share."""

    spark: SparkSession
    path: str

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _numbers(self, inside: str) -> list[int]:
        """Numbers of the commits that have a path."""
        pattern = self._path(f"commit=*{inside}")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(str(f.getPath().toString()).split("/commit=")[-1].split("/")[0]) for f in found or [])

    def _commits(self) -> list[int]:
        """Numbers of the complete commits."""
        return self._numbers("/batches/_SUCCESS")

    def _take(self, attempt: str, number: int) -> bool:
        """Gives a written commit its number; False if another one has it."""
        source, target = self._path(attempt), self._path(f"commit={number:012d}")
        fs = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        context = fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, options)
        except Py4JJavaError:
            if number in self._numbers(""):
                return False
            raise
        return True

    def _at(self, commit: int) -> str:
        return f"{self.path}/commit={commit:012d}"

    def _known(self, commits: list[int]) -> DataFrame:
        """Ids of the batches of these commits."""
        together = [n for n in self._numbers("/all/_SUCCESS") if n in commits]
        last = together[-1] if together else -1
        paths = [f"{self._at(n)}/batches" for n in commits if n > last]
        paths += [f"{self._at(last)}/all"] if together else []
        if not paths:
            return local_rows(self.spark, [], "batch string")
        return self.spark.read.schema("batch string").parquet(*paths)

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens`` of the latest commit."""
        return self._totals(self._commits())

    def _totals(self, commits: list[int]) -> DataFrame:
        if not commits:
            return local_rows(self.spark, [], _TOTALS)
        return self.spark.read.schema(_TOTALS).parquet(f"{self._at(commits[-1])}/totals")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False if it was added before."""
        if batch_id is None:
            raise ValueError("A batch needs an id")
        while True:
            commits = self._commits()
            number = max(self._numbers(""), default=-1) + 1
            if commits != self._commits():
                continue  # one came in between: number and totals must belong together
            known = self._known(commits)
            if not known.where(F.col("batch") == batch_id).isEmpty():
                return False
            sums = [F.sum(c).alias(c) for c in ("n_docs", "n_tokens")]
            parts = [self._totals(commits), changes.groupBy(*KEYS).agg(*sums)]
            after = reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(*sums)
            attempt = f"attempt-{uuid.uuid4().hex}"
            after.where("n_docs != 0 OR n_tokens != 0").write.parquet(f"{self.path}/{attempt}/totals")
            own = local_rows(self.spark, [(batch_id,)], "batch string")
            if len(commits) % TOGETHER == TOGETHER - 1:
                known.union(own).write.parquet(f"{self.path}/{attempt}/all")
            own.write.parquet(f"{self.path}/{attempt}/batches")
            if self._take(attempt, number):
                return True
            place = self._path(attempt)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
