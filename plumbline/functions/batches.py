"""Arrow batches in small parts, so that a task's Python holds little at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a part, and bytes of one column, unless a single row has more.
ROWS, BYTES = 256, 1 << 20


def parts(batches: Iterable[pa.RecordBatch], column: int | str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in their order, a few at a time: so many at most, whose texts or
    binaries in a column have so many bytes together. A row that has more is a part of its own."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < b.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(at, to - at)
            at, before = to, int(ends[to - 1])
