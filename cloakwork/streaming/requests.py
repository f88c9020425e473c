"""Run requests as a stream of tag changes.

Selection reads the folded tag *state*, not the events of a batch: a dataset whose run failed keeps
its run tag and is tried again. With an interval a clock is part of the stream, so there is a batch
every interval, with changes or without; :meth:`RequestLoop.poll` does the same by hand.

State under ``path``:

* ``state/batch=<n>``: all changes up to batch n, folded. A batch reads the last one before it and writes
  its own, so running it again gives the same result. The last two are kept.
* ``outcomes/batch=<n>``: tag changes made by runs after state n. The next batch folds them; they go when
  no batch that could run again needs them.

Folding takes the last change of each tag, so the size is that of the catalog's tags, however long the
history, and nothing is written by a batch that brings nothing and runs nothing. An error that is not a
dataset's own becomes a row of the audit, and the loop goes on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import RUN_TAG
from ..operators.catalog import Catalog, run_requests
from ..operators.tags import ENTITY, fold_changes, outcome_changes, with_tags
from ..plans.cycle import CycleResult, RunConfig, run_cycle, safe_message
from ..session import local_rows, scratch_removed, stored
from ..sources.audit import AuditLog
from ..sources.published import Files, literal_path
from .rows import triggered

# One number orders all changes: the sequence number of a change, then the outcomes of runs that have
# seen it. A hash aggregate can hold it.
STATE_SCHEMA = "urn string, field_path string, tag string, op string, at decimal(30,0)"
_PHASES = 2**31


class RequestLoop:
    """Folds tag changes ``urn, field_path, tag, op, seq`` and runs what they ask for.

    Without ``config`` it only keeps the tag state.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        *,
        catalog: Catalog | None = None,
        config: RunConfig | None = None,
    ) -> None:
        if config is not None and catalog is None:
            raise ValueError("Runs need a catalog of fields")
        self.spark = spark
        self.path = path.rstrip("/")
        self.catalog = catalog
        self.config = config

    def start(
        self, changes: DataFrame, checkpoint: str, *, interval: int | None = None
    ) -> StreamingQuery:
        """Everything there is now, or with an ``interval`` a batch every so many seconds.

        The clock of an interval is a source of its own, so a checkpoint belongs to one of both ways.
        """
        rows = changes.select(*ENTITY, "op", F.col("seq").cast("bigint").alias("seq"))
        if interval is not None:
            clock = self.spark.readStream.format("rate").option("numPartitions", 1).load()
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
            rows = rows.unionByName(clock.select(*nothing))
        writer = rows.writeStream.foreachBatch(self.process_batch)
        return triggered(writer.option("checkpointLocation", checkpoint), interval).start()

    def process_batch(self, changes: DataFrame, batch_id: int) -> None:
        with scratch_removed(self.spark):
            at = (F.col("seq").cast("decimal(20,0)") * _PHASES).cast("decimal(30,0)")
            new = changes.where("urn IS NOT NULL").select(*ENTITY, "op", at.alias("at"))
            before = max((n for n in self._numbers("state") if n < batch_id), default=-1)
            made = [n for n in self._numbers("outcomes") if n >= before]
            if made or not new.isEmpty():
                parts = self._read("state", [before]).unionByName(self._read("outcomes", made))
                folded = fold_changes(parts.unionByName(new), order=("at",))
                folded.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")
            self._forget(before)
            if self.config is not None:
                self._try(batch_id)

    def poll(self) -> CycleResult | None:
        """Run what is still asked for, without new changes. Not while the stream is active."""
        return self._run(max(self._numbers("state"), default=-1))

    def changes(self) -> DataFrame:
        """Last change of every tag."""
        last = max(self._numbers("state"), default=-1)
        made = [n for n in self._numbers("outcomes") if n >= last]
        return fold_changes(self._read("state", [last]).unionByName(self._read("outcomes", made)), order=("at",))

    def state(self) -> DataFrame:
        """Tags in force: ``urn, field_path, tag``."""
        return self.changes().where("op = 'add'").select(*ENTITY)

    def _try(self, batch_id: int) -> None:
        try:
            if self._asked():
                self._run(batch_id)
        except Exception as error:
            AuditLog(self.spark, self.config.audit).error(safe_message(error))

    def _asked(self) -> bool:
        """Whether anything carries the run tag, in the state or in the catalog itself."""
        run = self.changes().where(F.col("tag") == RUN_TAG)
        if not run.where("op = 'add'").isEmpty():
            return True
        own = run_requests(self.catalog.datasets, self.catalog.fields)
        own = own.select("urn", F.coalesce("field_path", F.lit("")).alias("field_path"))
        return not own.join(run, ["urn", "field_path"], "left_anti").isEmpty()

    def _run(self, batch_id: int) -> CycleResult:
        changes = self.changes()
        tagged = with_tags(self.catalog, changes.where("op = 'add'"), changes.where("op = 'remove'"))
        tagged = Catalog(stored(tagged.datasets, "datasets"), stored(tagged.fields, "fields"))
        result = run_cycle(self.spark, tagged, self.config)
        made = outcome_changes(tagged.fields, result.audit, result.targets)
        seen = changes.groupBy("urn").agg(F.max("at").alias("seen"))
        at = (F.coalesce("seen", F.lit(0)) + 1).cast("decimal(30,0)")
        ordered = made.join(seen, "urn", "left").select(*ENTITY, "op", at.alias("at"))
        ordered.write.parquet(f"{self.path}/outcomes/batch={batch_id}/run={uuid.uuid4().hex}")
        AuditLog(self.spark, self.config.audit).fold()
        return result

    def _forget(self, before: int) -> None:
        """Removes what even a batch that is run again does not need: it reads state ``before``."""
        files = Files(self.spark)
        for kind in ("state", "outcomes"):
            for n in self._numbers(kind):
                if n < before:
                    files.remove(f"{self.path}/{kind}/batch={n}")

    def _numbers(self, kind: str) -> list[int]:
        """Batches with complete files."""
        files = Files(self.spark)
        inner = "" if kind == "state" else "/run=*"
        path = files.path(f"{literal_path(self.path)}/{kind}/batch=*{inner}/_SUCCESS")
        found = path.getFileSystem(files._conf).globStatus(path) or []
        return sorted({int(str(f.getPath().toString()).rsplit("/batch=", 1)[1].split("/")[0]) for f in found})

    def _read(self, kind: str, batches: list[int]) -> DataFrame:
        there = set(self._numbers(kind)) & set(batches)
        paths = [literal_path(f"{self.path}/{kind}/batch={n}") for n in sorted(there)]
        if not paths:
            return local_rows(self.spark, [], STATE_SCHEMA)
        found = self.spark.read.schema(STATE_SCHEMA).option("recursiveFileLookup", "true").parquet(*paths)
        return found.select(*ENTITY, "op", "at")
