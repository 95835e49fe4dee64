"""Arrow batches in Python by a few rows, so that a worker's memory is the batch's own and that of some rows' objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 256


def slices(batch: pa.Array, rows: int = ROWS) -> Iterator[list]:
    """A batch's values, so many at a time."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows).to_pylist()
