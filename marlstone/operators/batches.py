"""Arrow batches in slices of bounded size, so that what a worker holds doesn't grow with the batches that Spark deals it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a batch that are worked on at a time; a row is never cut.
SLICE_BYTES = 1 << 20


def slices(batches, at: int, most: int = SLICE_BYTES) -> Iterator:
    """The rows of batches in order, as batches of at most ``most`` bytes in the string column ``at``, or of one longer row."""
    for batch in batches:
        column, start = batch.column(at), 0
        offset = np.frombuffer(column.buffers()[1], np.int64 if str(column.type).startswith("large") else np.int32)[column.offset : column.offset + batch.num_rows + 1] if batch.num_rows else ()
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offset, offset[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end
