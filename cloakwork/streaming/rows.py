"""Tokenizing rows as they arrive: a stateless projection, so no watermark and no state."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.rewrite import check_columns, rewrite

# Shortest pause between two polls.
MIN_INTERVAL_SECONDS = 5


def tokenize_stream(stream: DataFrame, columns: list[str], **options: Any) -> DataFrame:
    """The stream with its target columns tokenized; same result as on a table."""
    check_columns(stream, columns)
    return rewrite(stream, columns, **options)


def triggered(writer: DataStreamWriter, interval: int | None) -> DataStreamWriter:
    """All that is there now, then stop; or every ``interval`` seconds."""
    if interval is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{max(interval, MIN_INTERVAL_SECONDS)} seconds")


def write_files(
    stream: DataFrame, path: str, checkpoint: str, *, interval: int | None = None
) -> StreamingQuery:
    """Parquet files, each input row exactly once."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return triggered(writer, interval).start(path)


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, *, interval: int | None = None
) -> StreamingQuery:
    """One folder ``batch=<id>`` per micro-batch, for readers without the sink's file log.

    A batch that is run again replaces its own folder with the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(writer, interval).start()
