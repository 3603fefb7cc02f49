"""Connected components by contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For each node of an edge its component's least node: columns ``node`` and ``root``.

    Every node hooks onto the least node of its neighbourhood, and twice onto the hook of its
    hook; edges are then drawn between the hooks, so the graph shrinks until no edge is left.
    The hooks of all rounds, one after another, lead from a node to its root. A node with any
    number of edges only ever meets grouped minima and joins whose large partitions Spark splits.
    """
    spark = edges.sparkSession
    left, path = shared.at_path(_between(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))), "edges")
    rounds: list[tuple[DataFrame, str]] = []
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        hooks = ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        rounds.append(shared.at_path(_onto(_onto(hooks, hooks), hooks), "hooks"))
        moved = _renamed(_renamed(left, rounds[-1][0], "a"), rounds[-1][0], "b")
        new_left, new_path = shared.at_path(_between(moved), "edges")
        shared.remove(spark, path)
        left, path = new_left, new_path
    shared.remove(spark, path)
    if not rounds:
        return edges.select(F.col(a).cast("long").alias("node"), F.col(a).cast("long").alias("root")).limit(0)
    labels = rounds[0][0]
    for hooks, _ in rounds[1:]:
        labels = _onto(labels, hooks)
    labels = shared.written(labels.withColumnRenamed("up", "root"), "labels")
    for _, old in rounds:
        shared.remove(spark, old)
    return labels


def _onto(hooks: DataFrame, more: DataFrame) -> DataFrame:
    """Each node's hook replaced by what ``more`` hooks that onto."""
    above = more.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
    return hooks.join(above, F.col("up") == F.col("n2"), "left").select("node", F.coalesce("up2", "up").alias("up"))


def _renamed(pairs: DataFrame, hooks: DataFrame, end: str) -> DataFrame:
    """The pairs with one end replaced by its hook."""
    other = "b" if end == "a" else "a"
    at = hooks.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
    return pairs.join(at, F.col(end) == F.col("n2")).select(F.col("up2").alias(end), other)


def _between(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of different nodes, the greater first."""
    return pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
