"""Counts in a table of fixed size, gathered from any number of tasks.

A task adds up the slots that it meets and hands them on by segment; each segment is summed by
one task of the next stage. The finished table has ``total`` numbers whatever the size of
the input, which bounds what reaches the driver and what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_BITS = 16
#: Steps of a count for each doubling.
STEPS = 6
#: Size of a mark table, as a power of two: a bit each.
MARK_BITS = 22


def counts(frame: DataFrame, slots: Callable[[pa.RecordBatch], np.ndarray], total: int) -> np.ndarray:
    """How often each slot below ``total`` occurs, as steps of a scale. ``slots`` gives the slots of a batch.

    Counts are added up in 64 bits. What comes back is a byte for each: ``STEPS`` steps for each
    doubling, 0 for none, so any count up to 2 ** 42 has a step of its own size and order.
    """
    step = min(total, 1 << SEGMENT_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def settled() -> tuple[np.ndarray, np.ndarray]:
            """All slots so far, each once, and how often each occurs; at most ``total`` of them."""
            found, index, n = np.unique(np.concatenate([own, *held]), return_inverse=True, return_counts=True)
            n = n.astype(np.int64)
            n[index[: len(own)]] += times - 1
            return found, n

        for batch in batches:
            held.append(slots(batch))
            if sum(map(len, held)) > total:
                own, times = settled()
                held.clear()
        own, times = settled()
        edges = np.searchsorted(own, np.arange(0, total + step, step))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[k], edges[k + 1])
            yield pa.record_batch({"segment": pa.array([k], pa.int32()), "at": pa.array([(own[part] - k * step).astype("<u2").tobytes()], pa.binary()), "times": pa.array([times[part].tobytes()], pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(step, np.int64)
        for at, times in zip(table.column("at"), table.column("times"), strict=True):
            out[np.frombuffer(at.as_buffer(), "<u2")] += np.frombuffer(times.as_buffer(), np.int64)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([np.ceil(STEPS * np.log2(1.0 + out)).astype(np.uint8).tobytes()], pa.binary())})

    parts = frame.mapInArrow(add, "segment int, at binary, times binary").groupBy("segment").applyInArrow(merge, "segment int, data binary")
    out = np.zeros(total, np.uint8)
    for row in parts.collect():  # a byte for each slot, whatever the input: not partition by partition, which would be a job each
        out[row.segment * step : (row.segment + 1) * step] = np.frombuffer(row.data, np.uint8)
    return out


def slot(key: Column) -> Column:
    """The slot of a key in a mark table."""
    return F.pmod(F.xxhash64(key), F.lit(1 << MARK_BITS))


def marks(keys: DataFrame, key: str) -> np.ndarray:
    """A mark table: a bit for each slot that a key falls into, packed (half a megabyte).

    It lets most rows of other keys be told apart without a shuffle; a few pass, so an exact
    step must follow where that matters.
    """
    return np.packbits(counts(keys.select(slot(F.col(key)).alias("slot")), lambda batch: np.asarray(batch.column(0)), 1 << MARK_BITS) > 0)


def marked(batches: Iterator[pa.RecordBatch], packed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose column ``slot`` is marked."""
    table = np.unpackbits(packed).astype(bool)
    for batch in batches:
        yield batch.filter(pa.array(table[np.asarray(batch.column(batch.schema.get_field_index("slot")))]))
