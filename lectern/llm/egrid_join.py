"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors have cosine >= c just when their distance is at most ``sqrt(2 - 2 c)``, the
width of the grid's cells. Vectors are rotated onto their principal axes and sorted by
their cells on the leading ``AXES`` of them, which range-partitions the table into a
sequence. The sequence is cut into intervals of at most ``BLOCK`` vectors, each with its
bounding box on these axes and on the length of what the axes leave over, and with its centre
and radius in all dimensions; ``FAN`` intervals together form one of the next level. Pairs of
intervals are joined from the top down, level by level as Spark joins, and pairs whose boxes or
balls are provably further apart than a cell is wide are skipped (``interval_pairs`` counts them).

The pairs left are dealt into tiles of ``SIDE`` by ``SIDE`` intervals, so an interval is moved
once for each tile of its row and column, not once for each pair. In a tile, a matrix product in
single precision finds candidates, which count only if their cosine in double precision is high
enough. A tile returns for each vector how many it links with and a spanning forest of the links,
so its result grows with the vectors, not with the links. Equal vectors are one vector with a
count until the end.

Clustered vectors let most pairs be skipped. Random vectors of many dimensions are at nearly equal
distances and exceed a cell on no axis, so there nothing can be skipped by geometry, and the work
is that of all pairs of intervals; the result is exact in both cases.

The rotation comes from at most ``SAMPLE`` vectors, those with the least hash of their content. It
decides how much is skipped, never what is found.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components
link with nothing; vectors of different lengths do not link. Rows that share a vec_id are
separate vectors; a null vec_id links with nothing and has a null component. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import graph, ordering, shared

COSINE = 0.9
AXES = 8
BLOCK = 4096
#: Numbers in an interval at most, for vectors of many dimensions.
NUMBERS = 1 << 22
FAN = 16
SIDE = 4
#: Rows of an interval that are compared at once.
SLICE = 512
SAMPLE = 4096

_BLOCKS = "part long, number long, dim int, n int, ids binary, copies binary, data binary, low array<double>, high array<double>, centre array<double>, radius double"


def _usable(vector: str):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each length the leading principal axes, from a bounded sample."""
    by_dim: dict[int, list] = {}
    for row in reps.select("dim", "vector").orderBy("h1", "h2").limit(SAMPLE).toLocalIterator():
        by_dim.setdefault(row.dim, []).append(row.vector)
    out = {}
    for dim, group in by_dim.items():
        x = _unit(np.array(group, dtype=np.float64))
        _, axes = np.linalg.eigh(np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(int(dim)))
        out[int(dim)] = axes[:, ::-1][:, :AXES]
    return out


def _unit(data: np.ndarray) -> np.ndarray:
    scale = np.abs(data).max(1, keepdims=True)
    data = data / scale
    return data / np.linalg.norm(data, axis=1, keepdims=True)


def _rotated(reps: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """The vectors with their coordinates on the leading axes and the cells of these."""
    shared_axes = reps.sparkSession.sparkContext.broadcast(axes)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            dims = np.asarray(batch.column(batch.schema.get_field_index("dim")))
            values, at = np.asarray(column.values, dtype=np.float64), np.asarray(column.offsets)
            at0 = at - at[0]
            values = values[at[0] : at[-1]]
            out = np.zeros((len(dims), AXES + 1))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                data = _unit(np.stack([values[at0[r] : at0[r + 1]] for r in rows]))
                basis = shared_axes.value.get(dim)
                basis = np.eye(dim)[:, :AXES] if basis is None else basis
                out[np.ix_(rows, range(basis.shape[1]))] = data @ basis
                out[rows, AXES] = np.sqrt(np.maximum(0, 1 - (out[rows, :AXES] ** 2).sum(1)))  # distances of these are below those of the rest
            cells = np.floor(out[:, :AXES] / width).astype(np.int32)
            lists = lambda x, kind: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), kind), x.shape[1]).cast(pa.list_(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(out, pa.float64()), lists(cells, pa.int32())], [*batch.schema.names, "place", "cells"])

    return reps.mapInArrow(run, "rep long, copies long, dim int, vector array<double>, place array<double>, cells array<int>")


def _intervals(rotated: DataFrame, block: int) -> DataFrame:
    """The sequence in grid order, cut into intervals; a row holds one interval."""

    def run(batches):
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def made(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            dim = table.column("dim")[0].as_py()
            place = np.array(table.column("place").to_pylist())
            data = np.asarray(table.column("vector").combine_chunks().values, dtype="<f8")
            unit = _unit(data.reshape(-1, dim))
            centre = unit.mean(0)
            single = data.astype("<f4")
            row = pa.record_batch({
                "part": pa.array([part], pa.int64()), "number": pa.array([number], pa.int64()), "dim": pa.array([dim], pa.int32()), "n": pa.array([len(table)], pa.int32()),
                "ids": pa.array([table.column("rep").to_numpy().astype("<i8").tobytes()], pa.binary()), "copies": pa.array([table.column("copies").to_numpy().astype("<i8").tobytes()], pa.binary()),
                "data": pa.array([(single if (single == data).all() else data).tobytes()], pa.binary()), "low": pa.array([place.min(0).tolist()], pa.list_(pa.float64())), "high": pa.array([place.max(0).tolist()], pa.list_(pa.float64())),
                "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([float(np.sqrt(((unit - centre) ** 2).sum(1).max()))]),
            })
            number += 1
            return row

        def cut(table: pa.Table, last: bool):
            """Intervals of one length of vector each; the rest is held unless it is the last."""
            dims = table.column("dim").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            rest = table.slice(0, 0)
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                most = max(1, min(block, NUMBERS // int(dims[low])))
                while high - low >= most or (low < high and (last or high < len(dims))):
                    step = min(most, high - low)
                    yield made(pa.table(table.slice(low, step).combine_chunks()))
                    low += step
                if low < high:
                    rest = table.slice(low, high - low)
            yield rest

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= block:
                *ready, rest = cut(pa.concat_tables(held).combine_chunks(), False)
                yield from ready
                held, size = [rest], len(rest)
        if size:
            *ready, _ = cut(pa.concat_tables(held).combine_chunks(), True)
            yield from ready

    keys = ["dim", *[F.col("cells")[i] for i in range(AXES)], F.col("place")[0], "rep"]
    count = max(1, min(ordering.partitions(rotated), -(-rotated.count() // block)))
    return rotated.repartitionByRange(count, *keys).sortWithinPartitions(*keys).select("rep", "copies", "dim", "vector", "place").mapInArrow(run, _BLOCKS)


def _near(width: float):
    """Whether two boxes (low, high and low2, high2) come within ``width`` of each other."""
    gaps = F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= F.lit(width * width * (1 + 1e-9) + 1e-9)


def _pairs(leaves: DataFrame, width: float, fan: int) -> tuple[DataFrame, list[str]]:
    """Pairs (first, second) of intervals that may hold near vectors, found from the top level down; and what to remove later.

    An interval has the number ``slot``, which ascends along the sequence.
    """
    paths = []
    levels = [leaves.select(F.col("slot").alias("node"), "dim", "low", "high", "centre", "radius")]
    size = leaves.agg(F.max("slot")).first()[0] + 1
    while size > fan:
        box = [F.array(*[f(F.col(c)[i]) for i in range(AXES + 1)]).alias(c) for c, f in (("low", F.min), ("high", F.max))]
        level, path = shared.at_path(levels[-1].groupBy(F.floor(F.col("node") / fan).alias("node")).agg(*box), "level")
        levels.append(level)
        paths.append(path)
        size = -(-size // fan)
    top = levels[-1].select("node", "low", "high")
    other = top.select(F.col("node").alias("b"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    # at most ``fan`` nodes at the top
    paired = top.withColumnRenamed("node", "a").withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(size - 1).cast("long"))))
    pairs = paired.join(other, "b").where(_near(width)).select("a", "b")
    for level in reversed(levels[:-1]):
        child = level.select(F.floor(F.col("node") / fan).alias("up"), F.col("node").alias("a2"), "low", "high")
        second = level.select(F.floor(F.col("node") / fan).alias("up2"), F.col("node").alias("b2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        down = pairs.join(child, F.col("a") == F.col("up")).join(second, F.col("b") == F.col("up2")).where((F.col("a2") <= F.col("b2")) & _near(width))
        pairs, path = shared.at_path(down.select(F.col("a2").alias("a"), F.col("b2").alias("b")), "interval-pairs")
        paths.append(path)
    balls = levels[0].select("node", "dim", "centre", "radius")
    pairs = pairs.join(balls.select(F.col("node").alias("a"), F.col("dim").alias("d1"), F.col("centre").alias("c1"), F.col("radius").alias("r1")), "a")
    pairs = pairs.join(balls.select(F.col("node").alias("b"), F.col("dim").alias("d2"), F.col("centre").alias("c2"), F.col("radius").alias("r2")), "b").where("d1 = d2")
    apart = F.aggregate(F.zip_with("c1", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.where(F.sqrt(apart) <= F.col("r1") + F.col("r2") + F.lit(width * (1 + 1e-9) + 1e-9))
    return pairs.select(F.col("a").alias("first"), F.col("b").alias("second")), paths


def _links(x: np.ndarray, y: np.ndarray, same: bool, cosine: float):
    """Slices of the link matrix of two sides: row numbers, column numbers, and which of them link."""
    low_x, low_y = x.astype(np.float32), y.astype(np.float32)
    for begin in range(0, len(x), SLICE):
        likely = low_x[begin : begin + SLICE] @ low_y.T >= np.float32(cosine - 1e-3)
        if same:
            likely[np.arange(len(likely)), begin + np.arange(len(likely))] = False
        r, c = np.flatnonzero(likely.any(1)) + begin, np.flatnonzero(likely.any(0))
        if len(r):
            link = x[r] @ y[c].T >= cosine
            if same:
                link &= r[:, None] != c[None, :]
            yield r, c, link


def _compare(cosine: float):
    """Links between the vectors of a tile's intervals: rows (0, vec, links) and (1, vec, vec)."""

    def run(key: tuple, content: pa.Table, pairs: pa.Table) -> pa.Table:
        ids, copies, unit, at = [], [], [], {}
        for row in content.to_pylist():
            data = np.frombuffer(row["data"], f"<f{len(row['data']) // (row['n'] * row['dim'])}").astype(np.float64)
            at[row["slot"]] = len(unit)
            ids.append(np.frombuffer(row["ids"], "<i8"))
            copies.append(np.frombuffer(row["copies"], "<i8"))
            unit.append(_unit(data.reshape(row["n"], row["dim"])))
        base = np.cumsum([0, *map(len, ids)])
        others = [np.zeros(len(x), np.int64) for x in ids]
        up = np.arange(base[-1])
        edges: list[tuple[int, int]] = []
        for first, second in zip(pairs.column("first").to_pylist(), pairs.column("second").to_pylist(), strict=True):
            i, j = at[first], at[second]
            for r, c, link in _links(unit[i], unit[j], i == j, cosine):
                others[i][r] += link @ copies[j][c]
                if i != j:
                    others[j][c] += copies[i][r] @ link
                # rows one by one, each against the whole of the other side, until nothing can be added
                for k, x in enumerate((base[i] + r).tolist()):
                    to = base[j] + c[link[k]]
                    to = to[up[to] != up[x]]
                    while len(to):
                        y = int(to[0])
                        up[up == max(up[x], up[y])] = min(up[x], up[y])
                        edges.append((x, y))
                        to = to[up[to] != up[x]]
        names = np.concatenate(ids)
        count = np.concatenate(others)
        seen = np.flatnonzero(count)
        ends = np.array(edges, dtype=np.int64).reshape(-1, 2)
        kinds = np.repeat(np.array([0, 1], np.int32), [len(seen), len(ends)])
        return pa.table({"kind": kinds, "x": np.concatenate([names[seen], names[ends[:, 0]]]), "y": np.concatenate([count[seen], names[ends[:, 1]]])})

    return run


def _sequence(reps: DataFrame, width: float, block: int, fan: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """The intervals, the pairs of them that may hold near vectors, and what to remove later."""
    rotated = _rotated(reps.select("rep", "copies", "dim", "vector"), _axes(reps), width)
    cut, cut_path = shared.at_path(_intervals(rotated, block), "intervals")
    longest = cut.agg(F.max("number")).first()[0] + 1
    leaves = cut.withColumn("slot", F.col("part") * longest + F.col("number"))
    pairs, paths = _pairs(leaves, width, fan)
    pairs, path = shared.at_path(pairs, "pairs")
    return leaves, pairs, [cut_path, path, *paths]


def _distinct(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their hashes, and each usable vector once with a number of its own (``rep``)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("usable", _usable("vector") & F.col("vec_id").isNotNull())
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), F.col("vector")))
    alike = rows.where("usable").groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "vector")).alias("x"), F.count("*").alias("copies"))
    return rows, alike.select("h1", "h2", F.monotonically_increasing_id().alias("rep"), F.col("x.vec_id").alias("least"), "copies", F.size("x.vector").alias("dim"), F.col("x.vector").alias("vector"))


def interval_pairs(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, fan: int = FAN) -> tuple[int, int]:
    """How many pairs of intervals are compared, and how many there are."""
    reps = shared.written(_distinct(vectors)[1], "vectors")
    leaves, pairs, _ = _sequence(reps, math.sqrt(2 - 2 * cosine), block, fan)
    n = leaves.count()
    return pairs.count(), n * (n + 1) // 2


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """For every vector vec_id, n_links, component_id, kept; see the module's text."""
    spark = vectors.sparkSession
    rows, reps = _distinct(vectors)
    reps = shared.written(reps, "vectors")
    if reps.isEmpty():
        links = reps.select("rep").withColumn("others", F.lit(0).cast("long"))
        roots = reps.select(F.col("rep").alias("node"), F.col("rep").alias("root"))
    else:
        leaves, pairs, paths = _sequence(reps, math.sqrt(2 - 2 * cosine), block, fan)
        row, column = (F.floor(F.col(c) / SIDE) for c in ("first", "second"))
        sides = pairs.select(row.alias("row"), column.alias("column"), F.explode(F.array("first", "second")).alias("slot")).distinct()
        content = sides.join(leaves.select("slot", "dim", "n", "ids", "copies", "data"), "slot")
        tiled = pairs.select(row.alias("row2"), column.alias("column2"), "first", "second")
        found = content.groupBy("row", "column").cogroup(tiled.groupBy("row2", "column2")).applyInArrow(_compare(cosine), "kind int, x long, y long")
        found = shared.written(found, "links")
        for path in paths:
            shared.remove(spark, path)
        links = found.where("kind = 0").groupBy(F.col("x").alias("rep")).agg(F.sum("y").alias("others"))
        roots = graph.components(found.where("kind = 1"), "x", "y")
    per_rep = reps.select("h1", "h2", "rep", "least", "copies").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    groups = per_rep.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where("n > 1").select("root", "component_id")
    per_rep = per_rep.join(groups, "root", "left").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = rows.where("usable").select("vec_id", "h1", "h2").join(per_rep, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
