"""How much text fits a model's window, and how texts are dealt into calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from lectern.functions import text as T
from lectern.operators import analysis, chunking, grouping

# Tokens kept free for the answer and the prompt, and the most calls of a summary.
OUTPUT, RESERVE, CEILING, FLOOR, LEAST_WORDS = 512, 300, 12, 128, 200
TRANSLATION_RESERVE, TRANSLATION_INPUT, TRANSLATION_LEAST = 300, 1800, 120
TOKENS_PER_WORD, SOURCE_TOKENS, TARGET_TOKENS = 1.3, 2.5, 3.0


def usable_tokens(context: Column) -> Column:
    """Tokens left for text in a window of at least 1024."""
    return F.greatest(F.lit(1024), F.coalesce(F.floor(context), F.lit(0))) - OUTPUT - RESERVE


def summary_words(context: Column) -> Column:
    """Words of text for one call of a summary or comparison."""
    return F.greatest(F.lit(LEAST_WORDS), F.floor(usable_tokens(context) / TOKENS_PER_WORD)).cast("long")


def translation_words(context: Column) -> Column:
    """Words of text for one call of a translation: never more than the window holds."""
    fits = F.floor((context - TRANSLATION_RESERVE) / (SOURCE_TOKENS + TARGET_TOKENS))
    good = F.greatest(F.lit(TRANSLATION_LEAST), F.least(fits, F.lit(int(TRANSLATION_INPUT // SOURCE_TOKENS))))
    return F.greatest(F.lit(1), F.least(good, fits)).cast("long")


def split_budget(a: Column, b: Column, total: Column) -> tuple[Column, Column]:
    """Shares of a budget for two texts: half each at most, what one leaves goes to the other."""
    total, a, b = F.greatest(F.floor(total), F.lit(0)), F.greatest(a, F.lit(0)), F.greatest(b, F.lit(0))
    half = F.floor(total / 2)
    first, second = F.least(a, half), F.least(b, half)
    more = F.least(a - first, total - first - second)
    rest = F.least(b - second, total - first - second - more)
    return F.greatest(F.lit(1), first + more).cast("long"), F.greatest(F.lit(1), second + rest).cast("long")


def packed(pieces: DataFrame, budget: Column | int, key: str = "doc_id") -> DataFrame:
    """Pieces (key, ordinal, cost) with the window each falls into: greedy in order, a window closed before the piece that exceeds it.

    Pieces without cost are in no window. A piece's cost is at most the budget (longer texts are cut before).
    """
    return grouping.greedy(pieces.where("cost > 0"), key, budget, name="window")


def pieces(texts: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """Texts (key, ordinal, text) as pieces (key, ordinal, part, text, cost) that each fit the budget; blank ones give none."""
    schema = T_.StructType([texts.schema[key], texts.schema["ordinal"], *T_.StructType.fromDDL("part int, text string, cost long").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, o, i, part, cost) for k, o, text in zip(frame[key], frame.ordinal, frame.text, strict=True) for i, (part, cost) in enumerate(chunking.windows(text, budget, 0))]
            yield pd.DataFrame(rows, columns=["k", "ordinal", "part", "text", "cost"]).rename(columns={"k": key})

    counted = texts.where("text IS NOT NULL").select(key, "ordinal", "text", T.token_count(F.col("text")).alias("cost"))
    whole = counted.where(F.col("cost").between(1, budget)).select(key, "ordinal", F.lit(0).alias("part"), "text", "cost")
    return whole.unionByName(counted.where(F.col("cost") > budget).select(key, "ordinal", "text").mapInPandas(run, schema))


def _windows(cut: DataFrame, budget: int, key: str, extra: list[Column] = ()) -> DataFrame:
    """Windows (key, window, text, tokens, ordinals) of pieces, the texts joined by a blank line."""
    places = cut.withColumn("_at", F.struct("ordinal", "part"))
    grouped = packed(places.select(key, F.col("_at").alias("ordinal"), "cost"), budget, key).select(key, F.col("ordinal").alias("_at"), "window")
    joined = places.join(grouped, [key, "_at"]).groupBy(key, "window").agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("x"), F.sum("cost").alias("tokens"), *extra)
    return joined.select(key, "window", F.array_join("x.text", "\n\n").alias("text"), "tokens", F.array_distinct("x._at.ordinal").alias("ordinals"), *[c for c in joined.columns if c not in (key, "window", "x", "tokens")])


def compare_windows(chunks: DataFrame, context: int, key: str = "pair_id") -> DataFrame:
    """Windows (key, window, text, tokens, ordinals) over the first document's chunks (key, ordinal, text) of each pair, in order.

    A window takes half of a call's words; the other half, ``compare_plan``'s ``pair_words``, is left
    for what is found in the second document. Longer chunks are cut. At most ``CEILING`` windows are kept.
    """
    share = compare_shares(context)[0]
    return _windows(pieces(chunks, share, key), share, key).where(F.col("window") < CEILING)


def compare_shares(context: int) -> tuple[int, int]:
    """Words of one call for the first and for the second document."""
    words = max(LEAST_WORDS, int((max(1024, context) - OUTPUT - RESERVE) / TOKENS_PER_WORD))
    first = max(100, words // 2)
    return first, max(100, words - first)


def compare_plan(chunks: DataFrame, context: int, key: str = "pair_id") -> DataFrame:
    """Per pair the calls of a comparison: windows kept, whether text of the first document is left out, tokens of each partial answer, words for the second document, and steps."""
    share, other = compare_shares(context)
    cut = pieces(chunks, share, key)
    rows = packed(cut.select(key, F.struct("ordinal", "part").alias("ordinal"), "cost"), share, key).groupBy(key).agg((F.max("window") + 1).alias("n"))
    kept = F.least("n", F.lit(CEILING))
    most = F.greatest(F.lit(FLOOR), F.least(F.lit(OUTPUT), F.floor((max(1024, context) - OUTPUT - RESERVE) / kept)))
    return rows.select(key, kept.alias("windows"), (F.col("n") > CEILING).alias("truncated"), most.cast("long").alias("answer_tokens"), F.lit(other).alias("pair_words"), (kept + 2).alias("steps"))


def translation_blocks(segments: DataFrame, page_counts: DataFrame, context: int) -> DataFrame:
    """A translation's blocks (doc_id, block, kind, text, first, last) in reading order.

    Segments (doc_id, ordinal, page, text) between missing pages are packed into windows; a block of
    kind ``gap`` stands at the place of each run of pages without a segment, up to the document's
    ``page_count``. Documents with a segment without a page have no gaps.
    """
    budget = max(1, min(max(TRANSLATION_LEAST, min(int((context - TRANSLATION_RESERVE) // (SOURCE_TOKENS + TARGET_TOKENS)), int(TRANSLATION_INPUT // SOURCE_TOKENS))), int((context - TRANSLATION_RESERVE) // (SOURCE_TOKENS + TARGET_TOKENS))))
    paged = segments.join(segments.where("page IS NULL").select("doc_id").distinct(), "doc_id", "left_anti")
    gaps = analysis.missing_pages(paged.join(page_counts, "doc_id").select("doc_id", F.col("page").cast("int").alias("page"), "page_count"))
    order = W.partitionBy("doc_id").orderBy("last")
    gaps = gaps.withColumn("gap", F.row_number().over(order))
    # a segment comes behind every gap that ends before its page, or before a page that came earlier
    marks = gaps.select("doc_id", F.col("last").alias("page"), F.col("gap"), F.lit(None).cast("long").alias("ordinal"))
    both = marks.unionByName(segments.select("doc_id", F.col("page").cast("int").alias("page"), F.lit(None).cast("int").alias("gap"), F.col("ordinal").cast("long").alias("ordinal")))
    passed = F.coalesce(F.max("gap").over(W.partitionBy("doc_id").orderBy("page", F.col("gap").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    runs = both.withColumn("passed", passed).where("ordinal IS NOT NULL")
    runs = runs.withColumn("run", F.max("passed").over(W.partitionBy("doc_id").orderBy("ordinal"))).select("doc_id", "ordinal", "run")
    rows = segments.withColumn("ordinal", F.col("ordinal").cast("long")).join(runs, ["doc_id", "ordinal"]).select(F.struct("doc_id", "run").alias("place"), "ordinal", "text")
    made = _windows(pieces(rows, budget, "place"), budget, "place").select(F.col("place.doc_id").alias("doc_id"), F.col("place.run").alias("run"), F.lit(0).alias("_gap"), "window", F.lit("window").alias("kind"), "text", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    holes = gaps.select("doc_id", (F.col("gap") - 1).alias("run"), F.lit(1).alias("_gap"), F.lit(0).alias("window"), F.lit("gap").alias("kind"), F.lit(None).cast("string").alias("text"), F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))
    block = F.row_number().over(W.partitionBy("doc_id").orderBy("run", "_gap", "window")) - 1
    return made.unionByName(holes).select("doc_id", block.alias("block"), "kind", "text", "first", "last")


def summary_plan(pieces: DataFrame, context: int, key: str = "doc_id") -> DataFrame:
    """Per document the calls of a summary: windows kept, whether text is left out, tokens of each partial answer, and steps."""
    rows = packed(pieces, summary_words(F.lit(context)), key).groupBy(key).agg((F.max("window") + 1).alias("n"))
    kept = F.least("n", F.lit(CEILING))
    single = kept <= 1
    most = F.when(single, OUTPUT).otherwise(F.greatest(F.lit(FLOOR), F.least(F.lit(OUTPUT), F.floor(usable_tokens(F.lit(context)) / kept))))
    return rows.select(key, kept.alias("windows"), (F.col("n") > CEILING).alias("truncated"), most.cast("long").alias("answer_tokens"), F.when(single, 1).otherwise(kept + 1).alias("steps"))


def halved(changes: DataFrame, budget: int, key: str = "pair_id") -> DataFrame:
    """The leading changes (key, ordinal, cost) of each pair that fit a budget, their number halved until they do; one stays in any case."""
    rows = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "cost"))).alias("c"))
    sums = lambda n: F.aggregate(F.slice("c", 1, n), F.lit(0).cast("long"), lambda s, x: s + x["cost"])
    sizes = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.greatest(F.lit(1), F.floor(F.size("c") / F.pow(F.lit(2), k)).cast("int")))
    kept = F.coalesce(F.get(F.filter(sizes, lambda n: sums(n) <= budget), F.lit(0)), F.lit(1))
    return rows.select(key, kept.alias("kept"), (kept < F.size("c")).alias("cut"))


def shortened(text: Column, most: int) -> Column:
    """The leading words of a text that cost at most so many tokens, one at least; for texts with blanks between words."""
    words = T.words(text)
    costs = F.aggregate(words, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("full")), lambda s, w: F.struct((s["sum"] + T.word_cost(w)).alias("sum"), (s["n"] + F.when(s["full"] | ((s["sum"] + T.word_cost(w) > most) & (s["n"] > 0)), 0).otherwise(1)).alias("n"), (s["full"] | (s["sum"] + T.word_cost(w) > most)).alias("full")))
    return F.array_join(F.slice(words, F.lit(1), costs["n"]), " ")


def marked_snippet(text: Column, terms: list[str], words: int = 12) -> Column:
    """The words around the first of the terms, each hit in brackets, an ellipsis where words are left out."""
    own = T.words(text)
    plain = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", "")
    hits = F.filter(F.transform(own, lambda w, i: F.when(plain(w).isin(*terms), i)), lambda i: i.isNotNull())
    first = F.greatest(F.lit(0), F.coalesce(F.get(hits, F.lit(0)), F.lit(0)) - words // 3)
    shown = F.transform(F.slice(own, first + 1, words), lambda w: F.when(plain(w).isin(*terms), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.concat(F.when(first > 0, "…").otherwise(""), F.array_join(shown, " "), F.when(first + words < F.size(own), "…").otherwise(""))
