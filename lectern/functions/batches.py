"""Arrow batches in parts, so that what a kernel makes of texts in Python stays small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel holds as Python strings at once.
AT_ONCE = 1 << 20


def parts(batches: Iterator[pa.RecordBatch], *texts: str, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have ``most`` bytes (lists: elements) together at most; a row that is longer stands alone."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for name in texts:
            column = batch.column(name)
            ends += pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(ends)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
