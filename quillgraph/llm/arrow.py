"""Arrow helpers shared by the operators that run numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_ROWS = 256
SLICE_BYTES = 8 << 20


def slices(
    batch: pa.RecordBatch, column: str, most_rows: int = SLICE_ROWS, most_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` of a slice holds few bytes; one long value is a slice of its own."""
    start, size = 0, 0
    values = batch.column(column)
    for at in range(batch.num_rows):
        length = len(values[at].as_buffer() or b"") if values[at].is_valid else 0
        if at > start and (size + length > most_bytes or at - start >= most_rows):
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += length
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """Apply ``make()(slice) -> columns`` to small slices of every Arrow batch.

    ``make`` runs once per task, so it may load a model or keep counters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_pydict(apply(part))

    return df.mapInArrow(run, schema)
