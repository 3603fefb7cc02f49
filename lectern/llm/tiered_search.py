"""Ranked lexical search over a tiered index, with proof of each answer's exactness.

The index holds a posting for each document and term: its impact, which the term's count and the
document's length give. Each term's postings lie in ``TIERS`` tiers: the first holds its highest
impacts, about ``FIRST`` of them or a 64th, the next an eighth, the last all others; where tiers
part follows from a count of each term's impacts by step, never from a sort of its postings. With a
term goes the greatest impact below each tier, its residual bound.

All items first meet the first tier alone. What a document could gain at most are the residuals of
the item's terms that it has not met. An item's answer is proven if no document outside what was
met can reach the score of the least of its best documents; items without proof go on to the next
tier, with those of their terms whose residuals together stand against it, and so on, up to the
last tier, beyond which nothing is left. Documents that the proof leaves in doubt are scored in
full, so results are those of a full scan whatever the tiers.

Defined results: terms are maximal runs of letters and digits of ASCII and of all other
characters, only A-Z lower-cased; a null text has none. Rows that share an id are documents, or
items, of their own; among equal scores and ids the order is that of the table. Items without terms,
and documents without a term of the item, are in no result. Empty tables give an empty result.
Other columns are ignored. Equal terms of one document are found by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import dense, kernels, shared

TOP = 20
TIERS = 3
#: Postings of a term's first tiers: so many, or this part of them.
FIRST, PARTS = 1000, (64, 8)
#: Impacts of one step of the counts that tell tiers apart; impacts are below a million.
STEP = 4096
#: Rows up to which a table with one row for each term or pair of item and term is broadcast.
BROADCAST_ROWS = 200_000
_MARKS = 22

#: Bytes outside terms.
_APART = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _APART[_low : _high + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclasses.dataclass
class Index:
    """Tables of a tiered index: postings by tier, terms with document counts and residuals, and two totals."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    length: int


def occurrences(texts: DataFrame, marks: np.ndarray | None = None) -> DataFrame:
    """For each row and each of its terms the count; ``n`` is the row's number of terms with repeats.

    ``texts`` has ``row``, ``id`` and ``text``. Each row with terms has also one of the empty term,
    with count 0. ``marks`` leaves out terms in unmarked slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None if marks is None else np.unpackbits(marks).astype(bool)
        for batch in kernels.blocks(batches, "text"):
            raw, offsets = kernels.text_buffer(batch.column(2))
            starts, ends, before = kernels.word_ranges(raw, offsets, _APART)
            counts = np.diff(before)
            hashes = kernels.segment_hashes(raw, starts, ends, lower=True)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            if kept is not None:
                at = np.flatnonzero(kept[_slots(hashes)])
                starts, ends, hashes, owner = starts[at], ends[at], hashes[at], owner[at]
            distinct, code = np.unique(hashes, return_inverse=True)
            pairs, first, times = np.unique(owner * max(len(distinct), 1) + code, return_index=True, return_counts=True)
            lowered = _LOWER[raw]
            sizes = (ends - starts)[first]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            data = lowered[np.arange(int(upto[-1])) - np.repeat(upto[:-1] - starts[first], sizes)] if len(first) else lowered[:0]
            terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())
            filled = np.flatnonzero(counts)
            rows = np.concatenate([filled, owner[first]])
            yield pa.record_batch({
                "row": batch.column(0).take(pa.array(rows)), "id": batch.column(1).take(pa.array(rows)), "n": pa.array(counts[rows], pa.int64()),
                "term": pa.concat_arrays([pa.array([""] * len(filled), pa.string()), terms]), "tf": pa.array(np.concatenate([np.zeros(len(filled), np.int64), times]), pa.int64())
            })

    return texts.mapInArrow(run, "row long, id long, n long, term string, tf long")


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _MARKS)).astype(np.int64)


def _marks(terms: DataFrame) -> np.ndarray:
    """Half a megabyte that marks the slots of all terms, however many they are."""

    def slots(batch: pa.RecordBatch) -> np.ndarray:
        raw, offsets = kernels.text_buffer(batch.column(0))
        return _slots(kernels.segment_hashes(raw, offsets[:-1], offsets[1:], lower=True))

    return np.packbits(dense.counts(terms.select("term"), slots, 1 << _MARKS) > 0)


def _with_rows(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), "text")


def _sent(frame: DataFrame, rows: int) -> DataFrame:
    """Broadcast where its number of rows is within bounds; else Spark shuffles both sides."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def build(documents: DataFrame, terms: DataFrame | None = None, key: str = "doc_id") -> tuple[Index, list[str]]:
    """An index of all documents, and the folders it lies in.

    ``terms`` (column ``term``) keeps postings of these terms alone: an index for a known set of
    items. Counts and lengths cover all documents and all their terms in any case.
    """
    spark = documents.sparkSession
    marks, known = None, None
    if terms is not None:
        known = terms.select("term").distinct()
        marks = _marks(known)
    found, raw_path = shared.at_path(occurrences(_with_rows(documents, key), marks), "occurrences")
    totals = found.where("term = ''").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, length = int(totals[0]), int(totals[1])
    found = found.where("term <> ''")
    m = F.lit(75) + F.expr(f"(25L * n * {total}L) div {max(length, 1)}L")
    scored = found.withColumn("m", m).withColumn("impact", F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")).select("row", "id", "term", "impact")
    if known is not None:
        scored = scored.join(_sent(known, known.count()), "term", "left_semi")

    steps = scored.groupBy("term", F.expr(f"impact div {STEP}L").alias("step")).agg(F.count("*").alias("rows"), F.max("impact").alias("most"))
    down = Window.partitionBy("term").orderBy(F.col("step").desc())
    steps = steps.withColumn("upto", F.sum("rows").over(down)).withColumn("df", F.sum("rows").over(Window.partitionBy("term")))
    tier = F.lit(TIERS - 1)
    for k in range(TIERS - 2, -1, -1):
        tier = F.when(F.col("upto") <= F.greatest(F.lit(FIRST), F.expr(f"df div {PARTS[k]}")), k).otherwise(tier)
    steps = steps.withColumn("tier", tier)
    cuts = [F.min(F.when(F.col("tier") <= k, F.col("step"))).alias(f"cut{k}") for k in range(TIERS - 1)]
    rest = [F.coalesce(F.max(F.when(F.col("tier") > k, F.col("most"))), F.lit(0)).alias(f"rest{k}") for k in range(TIERS)]
    weight = F.floor(1000 * F.log((F.lit(2 * total + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    table, terms_path = shared.at_path(steps.groupBy("term").agg(F.max("df").alias("df"), *cuts, *rest).withColumn("weight", weight), "terms")

    tier = F.lit(TIERS - 1)
    for k in range(TIERS - 2, -1, -1):
        tier = F.when(F.expr(f"impact div {STEP}L") >= F.col(f"cut{k}"), k).otherwise(tier)
    placed = scored.join(_sent(table.select("term", *[f"cut{k}" for k in range(TIERS - 1)]), table.count()), "term").select("row", "id", "term", "impact", tier.alias("tier"))
    folder = shared.new_path(spark, "postings")
    placed.write.mode("errorifexists").partitionBy("tier").parquet(folder)
    shared.remove(spark, raw_path)
    postings = spark.read.schema("row long, id long, term string, impact long, tier int").parquet(folder)
    return Index(postings, table.drop(*[f"cut{k}" for k in range(TIERS - 1)]), total, length), [folder, terms_path]


def _best(scores: DataFrame, top: int, *order: Column) -> DataFrame:
    """Each item's first rows; Spark keeps so many in each task before rows are dealt out."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """Each item's best documents: ``item_id, rank, doc_id, score``, and ``tier``, the deepest tier that its proof took."""
    spark = items.sparkSession
    old: list[str] = []

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame, path = shared.at_path(frame, name)
        old.append(path)
        return frame

    rests = F.array(*[F.col(f"rest{k}") for k in range(TIERS)])
    asked = occurrences(_with_rows(items, "item_id")).where("term <> ''").select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term", "tf")
    pairs = asked.join(index.terms, "term").select("item", "item_id", "term", (F.col("tf") * F.col("weight")).alias("w"), rests.alias("rests"), F.lit(0).alias("depth"), F.lit(False).alias("proven")).where("w > 0")
    pairs = kept(pairs, "pairs")
    number = pairs.count()
    met = []
    for deepest in range(TIERS):
        live = pairs.where("NOT proven").select("item", "item_id", "term", "w", "depth", F.col("rests")[F.col("depth")].alias("rest"))
        part = index.postings.where(F.col("tier") <= deepest).join(_sent(live, number), "term").where("tier <= depth")
        scores = kept(part.groupBy("item", "row", "id").agg(F.sum(F.col("w") * F.col("impact")).alias("part"), F.sum(F.col("w") * F.col("rest")).alias("seen")), "scores")
        least = _best(scores.select("item", "part"), top, F.col("part").desc()).groupBy("item").agg(F.count("*").alias("rows"), F.min("part").alias("least")).where(F.col("rows") == top)
        bounds = live.withColumn("gain", F.col("w") * F.col("rest")).join(F.broadcast(least.select("item", "least")) if number <= BROADCAST_ROWS else least.select("item", "least"), "item", "left")
        up = Window.partitionBy("item").orderBy("gain", "term")
        bounds = bounds.withColumn("upto", F.sum("gain").over(up)).withColumn("bound", F.sum("gain").over(Window.partitionBy("item"))).withColumn("least", F.coalesce("least", F.lit(0)))
        proof = (F.col("bound") < F.col("least")) | (F.col("bound") == 0)
        state = kept(bounds.select("item", "term", "upto", "bound", "least", proof.alias("now")), "bounds")
        live = pairs.where("NOT proven").join(_sent(state, number), ["item", "term"])
        done = live.where("now").select("item", "item_id", "term", "w", "depth", "bound", "least")
        met.append((scores, done, deepest))
        deeper = F.when((F.col("upto") >= F.col("least")) & (F.col("rests")[F.col("depth")] > 0), F.lit(deepest + 1)).otherwise(F.col("depth"))
        pairs = live.select("item", "item_id", "term", "w", "rests", deeper.alias("depth"), F.col("now").alias("proven"))
        if deepest + 1 == TIERS or state.where("NOT now").isEmpty():
            break
        pairs = kept(pairs.where("NOT proven"), "pairs")

    results = []
    for scores, done, deepest in met:
        totals = done.groupBy("item", "item_id").agg(F.max("bound").alias("bound"), F.max("least").alias("least"))
        doubt = scores.join(_sent(totals, number), "item").where(F.col("part") + F.col("bound") - F.col("seen") >= F.col("least"))
        doubt = kept(doubt.select("item", "item_id", "row", "id", "part"), "doubt")
        left = index.postings.where(F.col("tier") > 0).join(doubt.select("item", "row"), "row")
        more = left.join(_sent(done.select("item", "term", "w", "depth"), number), ["item", "term"]).where("tier > depth")
        more = more.groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("more"))
        doubt = doubt.join(more, ["item", "row"], "left").withColumn("part", F.col("part") + F.coalesce("more", F.lit(0)))
        results.append(doubt.select("item", "item_id", "row", "id", F.col("part").alias("score"), F.lit(deepest).alias("tier")))
    union = results[0]
    for more in results[1:]:
        union = union.unionByName(more)
    ranked = _best(union.where("score > 0"), top, F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("row").asc())
    out = shared.written(ranked.select("item_id", "rank", F.col("id").alias("doc_id"), "score", "tier"), "ranked")
    for path in old:
        shared.remove(spark, path)
    return out


def rank_all(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The best documents of each item, by an index of the items' terms that is removed afterwards."""
    terms = occurrences(_with_rows(items, "item_id")).where("term <> ''").select("term")
    index, folders = build(documents, terms)
    out = search(index, items, top)
    for folder in folders:
        shared.remove(documents.sparkSession, folder)
    return out
