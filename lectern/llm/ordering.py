"""Cutting a table into key ranges without moving it through one task."""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST = -(1 << 63)


def partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_points(frame: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values that cut the key into even ranges."""
    if parts < 2:
        return []
    at = frame.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in at})


def range_part(key: Column, cuts: list[int]) -> Column:
    """The number of cut points that are not above the key, found in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.array(*[F.lit(g[0]) for g in groups])
    fine = F.array(F.array(F.lit(cuts[0])), *[F.array(*[F.lit(x) for x in g]) for g in groups])
    group = F.size(F.filter(coarse, lambda c: c <= key))
    within = F.size(F.filter(F.element_at(fine, group + 1), lambda c: c <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * step + within).cast("int")


def part_of(value: int, cuts: list[int]) -> int:
    return bisect.bisect_right(cuts, value)
