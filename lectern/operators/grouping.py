"""Greedy groups of consecutive rows under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _runs(keys: pa.Array) -> np.ndarray:
    """Where runs of equal keys end; keys may be null or structs."""
    if pa.types.is_struct(keys.type):
        parts = keys.flatten()
    else:
        parts = [keys]
    new = np.zeros(len(keys) - 1, bool)
    for part in parts:
        before, after = part.slice(0, len(part) - 1), part.slice(1)
        new |= pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
        new |= pc.is_null(before).to_numpy(zero_copy_only=False) != pc.is_null(after).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new) + 1, len(keys))


def greedy(rows: DataFrame, key: str, budget: Column | int, least: int = 1, ordinal: str = "ordinal", cost: str = "cost", name: str = "group") -> DataFrame:
    """Rows (key, ordinal, cost) with the number, from 0, of the group of their key that each falls into.

    In the order of ``ordinal`` a group closes before the row that would exceed the budget, once it
    has ``least`` rows. Rows of a key are read in order from sorted partitions: what is kept between
    Arrow batches is one group's sum, and within a batch each group is one search in the prefix sums,
    so a key of any number of rows takes linear time and little memory. Null costs count as nothing;
    the budget is taken from a key's first row; keys may be null; rows with equal ordinals keep any order.
    """
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    sorted_rows = rows.select(key, ordinal, F.col(cost).cast("long").alias(cost), limit.cast("double").alias("_budget")).repartition(key).sortWithinPartitions(key, ordinal)
    schema = T.StructType([*sorted_rows.schema.fields[:3], T.StructField(name, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, now, group, total, n, most = False, None, 0, 0, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = _runs(batch.column(0))
            costs, budgets = pc.fill_null(batch.column(2), 0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            out, start = np.empty(batch.num_rows, np.int32), 0
            for stop in ends.tolist():
                value = batch.column(0)[start].as_py()
                if not started or value != now:
                    started, now, group, total, n, most = True, value, 0, 0, 0, budgets[start]
                sums = np.concatenate([[0], np.cumsum(costs[start:stop])])
                size, i = stop - start, 0
                while i < size:
                    closed = max(int(np.searchsorted(sums, most - total + sums[i], side="right")) - 1, i + max(0, least - n))
                    upto = min(closed, size)
                    out[start + i : start + upto] = group
                    total, n = total + sums[upto] - sums[i], n + upto - i
                    if closed < size:
                        group, total, n = group + 1, 0, 0
                    i = upto
                start = stop
            yield pa.record_batch([*(batch.column(k) for k in range(3)), pa.array(out)], names=schema.fieldNames())

    return sorted_rows.mapInArrow(run, schema)
