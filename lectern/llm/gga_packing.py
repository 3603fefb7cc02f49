"""Packing documents into sequences with a grouping genetic algorithm.

A document is its token ids and a final id 0; one longer than a sequence is cut into full
pieces, of which only the first may be shorter. Full pieces are sequences of their own. All
others are dealt by a hash into provinces of about ``PROVINCE`` pieces, and a province is
packed on several islands at once:

* an individual is a set of bins (groups of pieces), its fitness the mean squared fill;
* crossover injects well-filled bins of one parent whole into the other, whose bins with
  pieces that are now there twice are taken apart; displaced pieces first take the place of
  smaller ones in bins that they fill better, and what is displaced in the end is put back by
  best fit, the longest first;
* generations go on until the bound of all lengths is met or ``PATIENCE`` of them bring nothing;
* after each epoch an island's elite also goes to the next island of its province, so the
  elites travel through Spark's shuffle and no task needs more than one province.

Provinces are independent: more documents make more of them. What a province cannot fill,
less than one sequence on the whole, is the price of that.

Defined results: a null or empty text is the one id 0. Repeated rows are separate documents,
each packed once; a null doc_id is kept. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels, shared, token_ids

LENGTH = 2048
PROVINCE = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
#: Generations of an epoch at most, and without a fitter best before it ends.
GENERATIONS = 60
PATIENCE = 8
ELITES = 1
#: Displaced pieces that look for places of smaller ones.
SEEKERS = 24

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_STATE = "province long, island int, fitness double, uids array<long>, lengths array<int>, bins array<int>"


def pieces(documents: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """The pieces of every document, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids.encoder(vocabulary)
        for block in kernels.blocks(batches, "text"):
            ids, at = encoder.encode(block.column(block.schema.get_field_index("text")))
            out: list[list] = [[], [], [], []]
            owner = []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                data = ids[a:b].astype("<u4", copy=False).tobytes() + b"\0\0\0\0"
                total = b - a + 1
                begin, size, piece = 0, (total - 1) % length + 1, 0
                while begin < total:
                    owner.append(i)
                    for column, value in zip(out, (piece, begin, size, zlib.crc32(data[4 * begin : 4 * (begin + size)])), strict=True):
                        column.append(value)
                    begin, size, piece = begin + size, length, piece + 1
            doc_ids = block.column(block.schema.get_field_index("doc_id")).take(pa.array(owner, pa.int64()))
            yield pa.record_batch({"doc_id": doc_ids, "piece": pa.array(out[0], pa.int32()), "start": pa.array(out[1], pa.int64()), "length": pa.array(out[2], pa.int64()), "ids_crc32": pa.array(out[3], pa.int64())})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class Room:
    """Open bins by their free space; finds the fullest bin that a piece fits."""

    def __init__(self, length: int):
        self.length, self.mask, self.by_free = length, 0, [[] for _ in range(length + 1)]

    def add(self, free: int, number: int) -> None:
        self.by_free[free].append(number)
        self.mask |= 1 << free

    def take(self, size: int) -> tuple[int, int] | None:
        fitting = self.mask >> size
        if not fitting:
            return None
        free = size + (fitting & -fitting).bit_length() - 1
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        return free, number


def best_fit(order: list[int], lengths: list[int], bins: list[int], fill: list[int], length: int) -> None:
    """Put the pieces of ``order`` into open bins by best fit; bins and fill are changed."""
    room = Room(length)
    for number, used in enumerate(fill):
        if 0 < used < length:
            room.add(length - used, number)
    for i in order:
        size = lengths[i]
        got = room.take(size)
        free, number = got if got else (length, len(fill))
        if not got:
            fill.append(0)
        bins[i] = number
        fill[number] += size
        if free > size:
            room.add(free - size, number)


def settle(bins: np.ndarray, lengths: np.ndarray, loose: list[int], fill: list[int], length: int) -> list[int]:
    """Let displaced pieces, alone or as two, take the place of one smaller piece, fullest bins first; gives those displaced in the end.

    Each exchange makes a bin fuller, so there is an end. ``bins`` and ``fill`` are changed.
    """
    free = length - np.asarray(fill, dtype=np.int64)
    placed = np.flatnonzero(bins >= 0)
    placed = placed[free[bins[placed]] > 0]  # pieces of bins with room
    loose = sorted(loose, key=lambda i: -int(lengths[i]))
    seekers = loose[:SEEKERS]
    rest = loose[SEEKERS:]
    tries = 4 * SEEKERS
    while seekers and len(placed) and tries:
        tries -= 1
        own, room = lengths[placed], lengths[placed] + free[bins[placed]]
        options = [(int(lengths[i]), (i,)) for i in seekers] + [(int(lengths[a] + lengths[b]), (a, b)) for k, a in enumerate(seekers) for b in seekers[k + 1 :]]
        sizes = np.array([x for x, _ in options])
        order = np.argsort(sizes, kind="stable")
        # for each placed piece the largest option that fits in its stead
        best = np.searchsorted(sizes[order], room, side="right") - 1
        got = np.where(best >= 0, sizes[order][best], 0)
        gain = np.where(got > own, got - room, -length)  # 0 where the bin becomes full
        k = int(np.argmax(gain))
        if gain[k] <= -length or got[k] <= own[k]:
            break
        piece, chosen = int(placed[k]), options[order[best[k]]][1]
        number = int(bins[piece])
        free[number] -= int(got[k] - own[k])
        fill[number] += int(got[k] - own[k])
        bins[piece] = -1
        seekers = [i for i in seekers if i not in chosen] + [piece]
        for i in chosen:
            bins[i] = number
        placed = placed[placed != piece]
        placed = placed[bins[placed] != number] if not free[number] else np.append(placed, chosen)
    return seekers + rest


def _fitness(fill: np.ndarray, length: int) -> float:
    used = fill[fill > 0]
    return float(np.mean((used / length) ** 2)) if len(used) else 1.0


def _compact(bins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, bins = np.unique(bins, return_inverse=True)
    return bins, np.bincount(bins, weights=lengths).astype(np.int64)


def crossover(giver: np.ndarray, taker: np.ndarray, lengths: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """A child: well-filled bins of the giver, the taker's bins that they leave whole, the rest by best fit."""
    fill = np.bincount(giver, weights=lengths)
    chosen = (fill >= np.quantile(fill, 0.5)) & (rng.random(len(fill)) < 0.5)
    injected = chosen[giver]
    broken = np.zeros(int(taker.max()) + 1, bool)
    broken[taker[injected]] = True
    displaced = broken[taker] & ~injected
    child = np.where(injected, giver, taker + len(fill))
    kept = np.flatnonzero(~displaced)
    names, renamed = np.unique(child[kept], return_inverse=True)
    bins = np.full(len(lengths), -1)
    bins[kept] = renamed
    used = np.bincount(renamed, weights=lengths[kept], minlength=len(names)).astype(np.int64).tolist()
    return _put_back(bins, lengths, np.flatnonzero(displaced), used, length)


def _put_back(bins: np.ndarray, lengths: np.ndarray, loose: np.ndarray, used: list[int], length: int) -> np.ndarray:
    bins[loose] = -1
    left = np.array(settle(bins, lengths, loose.tolist(), used, length), dtype=np.int64)
    placed = bins.tolist()
    best_fit(left[np.argsort(-lengths[left], kind="stable")].tolist(), lengths.tolist(), placed, used, length)
    return np.array(placed)


def mutate(bins: np.ndarray, lengths: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """Take apart the emptiest bins and a few others, and put their pieces back by best fit."""
    fill = np.bincount(bins, weights=lengths)
    gone = rng.random(len(fill)) < 3 / len(fill)
    gone[np.argsort(fill)[:2]] = True
    loose = np.flatnonzero(gone[bins])
    used = np.where(gone, 0, fill).astype(np.int64).tolist()
    return _put_back(bins.copy(), lengths, loose, used, length)


def evolve(lengths: np.ndarray, individuals: list[np.ndarray], seed: int, length: int = LENGTH, generations: int = GENERATIONS, patience: int = PATIENCE) -> list[tuple[float, np.ndarray]]:
    """The fittest individuals of one island after an epoch, the best first."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // length)
    size = lengths.tolist()
    people = list(individuals)
    if not people or any(len({*b.tolist()}) > least for b in people):
        while len(people) < POPULATION:
            noise = rng.random(len(size)) * (0.15 * len(people)) * length * 0.25
            bins: list[int] = [-1] * len(size)
            best_fit(np.argsort(-(lengths + noise), kind="stable").tolist(), size, bins, [], length)
            people.append(np.array(bins))
            if max(bins) + 1 == least:
                break  # nothing can be better
    rank = lambda people: sorted(people, key=lambda x: (x[0], -x[1], x[2]))[:POPULATION]
    ranked = rank([(len({*b.tolist()}), _fitness(np.bincount(b, weights=lengths), length), k, b) for k, b in enumerate(people)])
    idle = 0
    for generation in range(generations):
        if ranked[0][0] <= least or idle >= patience:
            break
        k = len(ranked)
        a, b = (int(rng.integers(0, k)), int(rng.integers(0, k))) if generation % 2 else (0, int(rng.integers(1, k)) if k > 1 else 0)
        child = mutate(crossover(ranked[b][3], ranked[a][3], lengths, length, rng), lengths, length, rng)
        child, fill = _compact(child, lengths)
        before = ranked[0][:2]
        ranked = rank([*ranked, (len(fill), _fitness(fill, length), 1000 + generation, child)])
        idle = 0 if ranked[0][:2] != before else idle + 1
    return [(f, b) for _, f, _, b in ranked[:ELITES]]


def _epoch(length: int):
    """One epoch on one island; rows of pieces found the island, rows with bins are its elites."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        province, island = int(key[0]), int(key[1])
        first = frame.iloc[0]
        uids, lengths = np.asarray(first.uids), np.asarray(first.lengths, dtype=np.int64)
        people = [_compact(np.asarray(b), lengths)[0] for b in frame.sort_values(["fitness", "from_island"], ascending=[False, True]).bins if b is not None and len(b)]
        best = evolve(lengths, people, seed=province * 1009 + island * 31 + len(people), length=length)
        return pd.DataFrame({"province": province, "island": island, "fitness": [f for f, _ in best], "uids": [uids] * len(best), "lengths": [lengths.astype(np.int32)] * len(best), "bins": [b.astype(np.int32) for _, b in best]})

    return run


def pack(rows: DataFrame, length: int = LENGTH, province: int = PROVINCE, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Every piece of ``rows`` with sequence_id and offset. ``rows`` must give the same rows at each reading."""
    names = rows.columns
    spark = rows.sparkSession
    rows, rows_path = shared.at_path(rows.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    short = rows.where(F.col("length") < length)
    provinces = max(1, -(-short.count() // province))
    dealt = short.select(F.pmod(F.xxhash64("_uid"), F.lit(provinces)).alias("province"), "_uid", F.col("length").cast("int").alias("length"))
    # a province is of bounded size: its pieces fit one row
    gathered = dealt.groupBy("province").agg(F.array_sort(F.collect_list(F.struct("_uid", "length"))).alias("x"))
    empty = F.lit(None).cast("array<int>")
    state = gathered.select("province", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(0.0).alias("fitness"), F.col("x._uid").alias("uids"), F.col("x.length").alias("lengths"), empty.alias("bins"), F.lit(0).alias("from_island"))
    paths = []
    for epoch in range(epochs):
        state = state.groupBy("province", "island").applyInPandas(_epoch(length), _STATE)
        if epoch + 1 < epochs:
            state, path = shared.at_path(state, "islands")
            paths.append(path)
            stay = state.withColumn("from_island", F.col("island"))
            go = stay.withColumn("island", (F.col("island") + 1) % islands)
            state = stay.unionByName(go)
    best = state.groupBy("province").agg(F.max_by(F.struct("uids", "lengths", "bins"), F.struct("fitness", -F.col("island"))).alias("b"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uids, size, bins = (np.array(row["b"][c], dtype=np.int64) for c in ("uids", "lengths", "bins"))
                order = np.lexsort((uids, bins))
                upto = np.cumsum(size[order])
                begin = np.r_[0, np.flatnonzero(np.diff(bins[order])) + 1] if len(order) else np.zeros(0, np.int64)
                base = np.repeat((upto - size[order])[begin], np.diff(np.r_[begin, len(order)]))
                yield pa.record_batch({"_id": pa.array(uids[order]), "sequence_id": pa.array(row["province"] * (1 << 24) + bins[order]), "offset": pa.array(upto - size[order] - base)})

    placed = best.mapInArrow(place, "_id long, sequence_id long, offset long")
    packed = short.join(placed, F.col("_uid") == F.col("_id")).select(*names, "sequence_id", "offset")
    full = rows.where(F.col("length") >= length).select(*names, (-1 - F.col("_uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = shared.written(packed.unionByName(full), "packed")
    for path in (rows_path, *paths):
        shared.remove(spark, path)
    return out


def pack_documents(documents: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """All pieces of all documents, each with its place in a sequence."""
    return pack(pieces(documents, vocabulary, length), length)
