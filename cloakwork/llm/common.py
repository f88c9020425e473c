"""What the operators of this folder share: Arrow batches of texts, output columns, digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step looks at; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` that an operator's result columns ``names`` do not replace."""
    taken = {name.lower() for name in names}
    return [c for c in df.columns if c.lower() not in taken]


def text_steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges ``start, stop`` of rows whose texts have about ``most`` bytes together."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start, done = 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield start, stop
        done = int(ends[stop - 1])
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the places where they begin and end.

    NULL counts as an empty text.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def add_columns(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    compute: Callable[[pa.Array], list[pa.Array]],
    most: int = STEP_BYTES,
    drop: bool = False,
) -> DataFrame:
    """``df`` with new columns that ``compute`` derives from a column of texts, step by step.

    Columns of ``df`` with the names of the new ones are replaced; ``drop`` leaves the texts out.
    """
    kept = kept_columns(df, [f.name for f in fields] + ([text] if drop else []))
    source = df.select(*map(column, kept), column(text).alias("_text"))
    schema = T.StructType(source.schema.fields[:-1] + fields)
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n)
            for start, stop in text_steps(texts, most):
                part = batch.slice(start, stop - start)
                new = compute(part.column(n))
                names = batch.schema.names[:n] + [f.name for f in fields]
                yield pa.RecordBatch.from_arrays(part.columns[:n] + new, names=names)

    return source.mapInArrow(run, schema)
