"""Mixing sources to target weights along a time-varying curriculum.

Sources in code-point order, null last, get the weights 5, 2, 1 in turn. Together they
supply 150 % of all words; a source gives twice its size at most, and what it cannot give
is shared among the others by weight until none is above its limit.

Over the training time t in [0, 1] a source is asked for words at the rate
``target * (1 + slope * (1 - 2 t))``; integrated, it has been asked for
``target * (t + slope * t * (1 - t))`` words by the time t. Its documents stand in an order
fixed by a hash, one pass after another. A document's position is the time at which the
cumulative demand reaches the middle of its words, so inverting the demand gives the
position without any step-by-step simulation. The last document of a source's final pass
may give only its leading words, which makes the words taken equal to the rounded target.

Defined results: a null text has size 0; documents of size 0 are never taken and have no
position; a null source is a source of its own. Rows that share a doc_id are separate
documents. An empty table gives an empty result. Other columns do not matter.

Running sums never gather a source in one task: each source's hash range is cut into slices of
about ``ROWS`` rows of the table at most, whose totals alone are summed up by source. Sizes are
counted once and written without the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import ordering, shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (0.5, 0.0, -0.5)
SHARE = 1.5
LIMIT = 2
#: Rows of the whole table for each slice, of which there are 4096 at least.
ROWS = 1 << 16


def _digits(n: int) -> int:
    """Hexadecimal digits of the hash that choose a slice among so many rows."""
    return max(3, ((max(n, 1) - 1) // ROWS).bit_length() // 4 + 1)


def _sized(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("hash"), *more)


def targets(sized: DataFrame) -> DataFrame:
    """One row a source: source, source_size, weight, slope, target (from source and size)."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("turn").cast("int") + 1)
    shares = by_source.withColumn("turn", turn).select("source", "source_size", pick(WEIGHTS).alias("weight"), pick(SLOPES).alias("slope"))
    limit = F.col("source_size") * LIMIT
    full_first = W.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(W.unboundedPreceding, -1)
    after = full_first.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) * SHARE - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(after)
    shares = shares.withColumn("level", level).withColumn("open", F.col("level") <= limit / F.col("weight"))
    chosen = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), limit / F.col("weight"))).over(W.partitionBy())
    return shares.select("source", "source_size", "weight", "slope", F.when(F.col("open"), chosen * F.col("weight")).otherwise(limit.cast("double")).alias("target"))


def mix(documents: DataFrame, *more: str) -> DataFrame:
    """Every document with size, source_size, target, taken and its passes.

    ``passes`` lists for each time that the document is taken its number, its words and
    its training position in [0, 1].
    """
    small = shared.written(_sized(documents), "sized")
    digits = _digits(small.count())
    rows = (_sized(documents, *more) if more else small).withColumn("slice", F.substring("hash", 1, digits))
    goal = targets(small)
    sums = small.withColumn("slice", F.substring("hash", 1, digits)).groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    earlier = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("slice_start", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)))
    sums = sums.join(goal, sums["source"].eqNullSafe(goal["source"])).select(sums["source"].alias("s"), F.col("slice").alias("b"), "slice_start", "source_size", "slope", "target")
    rows = rows.join(sums, rows["source"].eqNullSafe(F.col("s")) & (F.col("slice") == F.col("b")))
    inside = W.partitionBy("source", "slice").orderBy("hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("slice_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = rows.withColumn("start", start)
    whole = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("asked", whole).withColumn("full", passes)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("asked") - F.col("full") * F.col("source_size") - F.col("start")))
    rows = rows.withColumn("rest", rest.cast("long"))

    def at(turn, words):
        """Where the demand t + slope * t * (1 - t) reaches the middle of the words."""
        share = (turn * F.col("source_size") + F.col("start") + words / 2) / F.col("asked")
        a = F.col("slope")
        root = F.sqrt(F.greatest(F.lit(0.0), (1 + a) * (1 + a) - 4 * a * share))
        return 2 * share / (1 + a + root)

    turns = F.when((F.col("size") > 0) & (F.col("full") > 0), F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).otherwise(F.array().cast("array<bigint>"))
    whole_passes = F.transform(turns, lambda k: F.struct(k.cast("int").alias("turn"), F.col("size").alias("words"), at(k, F.col("size")).alias("position")))
    last = F.when(F.col("rest") > 0, F.array(F.struct(F.col("full").cast("int").alias("turn"), F.col("rest").alias("words"), at(F.col("full"), F.col("rest")).alias("position"))))
    rows = rows.withColumn("passes", F.concat(whole_passes, F.coalesce(last, F.array().cast("array<struct<turn:int,words:bigint,position:double>>"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("rest")).cast("long").alias("taken"), "passes", *more)


def ordered(mixed: DataFrame) -> DataFrame:
    """Documents range-sorted by the position of their first pass; those never taken last."""
    first = mixed.withColumn("position", F.when(F.size("passes") > 0, F.element_at("passes", 1)["position"]).otherwise(F.lit(2.0)))
    return first.repartitionByRange(ordering.partitions(mixed), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def training_order(documents: DataFrame) -> DataFrame:
    """The corpus to train on: a row for each pass of each document, range-sorted by position.

    All columns of the documents stay; a pass of fewer words than the document has keeps
    its leading words, and ``n_chars``, if there, then counts what is kept.
    """
    names = documents.columns
    packed = documents.select("doc_id", "source", "text", F.struct(*names).alias("row"))
    rows = mix(packed, "row").where(F.size("passes") > 0).select("size", "row", F.explode("passes").alias("pass"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("pass.words").cast("int")), " ")
    text = F.when(F.col("pass.words") < F.col("size"), head).otherwise(F.col("row.text"))
    out = []
    for c in names:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("pass.words") < F.col("size"), F.length(head)).otherwise(F.col("row.n_chars")).cast(documents.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    rows = rows.select(*out, F.col("pass.position").alias("_position"))
    return rows.repartitionByRange(ordering.partitions(documents), "_position").sortWithinPartitions("_position").select(*names)
