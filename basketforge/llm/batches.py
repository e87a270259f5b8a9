"""Arrow batches in slices of few rows, so that a worker holds few texts as Python strings at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
