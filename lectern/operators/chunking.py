"""Windows of words over texts, and what chunks of one document share.

Windows depend on all words before them, so a small kernel cuts each text in one pass over its
words; Spark hands it Arrow batches, and only the finished chunks leave it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import batches as B
from lectern.functions import text as T

SIZE = 500
OVERLAP = 80
#: A document with more chunks is refused as a whole.
MOST_CHUNKS = 1000
#: Characters of two neighbours that are compared, for each token of overlap.
REACH = 20

_CHUNKS = "doc_id long, chunk_index int, text string, token_count long, shared int"
_SPACES = re.compile(f"{T.SPACE}+")
_SPACELESS = re.compile(T.SPACELESS)


def window_count(n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows over ``n`` words of one token each."""
    return F.when(n == 0, 0).otherwise(1 + F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap)))).cast("int")


def _pieces(word: str, size: int, overlap: int) -> list[tuple[str, int, bool]]:
    """Atoms (text, tokens, glued to the one before) of a word."""
    cost = len(_SPACELESS.findall(word))
    rest = [w for w in _SPACELESS.split(word) if w]
    cost += sum(1 if len(w) <= 16 else math.ceil(len(w) / 4) for w in rest)
    if cost <= size:
        return [(word, cost, False)]
    step = math.gcd(size, overlap) if overlap else size
    return [(word[i : i + step], 1 if len(word[i : i + step]) <= 16 else math.ceil(len(word[i : i + step]) / 4), i > 0) for i in range(0, len(word), step)]


def tokens(text: str) -> int:
    """Approximate tokens of a text, as ``T.token_count`` counts them."""
    rest = [w for part in _SPACES.split(text) for w in _SPACELESS.split(part) if w]
    return len(_SPACELESS.findall(text)) + sum(1 if len(w) <= 16 else math.ceil(len(w) / 4) for w in rest)


def split_words(text: str) -> list[str]:
    """The words of a text, as ``T.words`` finds them."""
    return [w for w in _SPACES.split(text) if w]


def word_windows(words: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """Windows (text, words) that count every word as one."""
    step = size - overlap
    count = 1 + max(0, -(-(len(words) - size) // step)) if words else 0
    return [(" ".join(words[k * step : k * step + size]), len(words[k * step : k * step + size])) for k in range(count)]


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """Windows (text, tokens) over any text, words of any cost."""
    words = [w for w in _SPACES.split(text) if w]
    if max(map(len, words), default=0) <= 16 and not _SPACELESS.search(text):
        return word_windows(words, size, overlap)
    atoms = [a for w in words for a in _pieces(w, size, overlap)]
    out, start = [], 0
    while start < len(atoms):
        stop, total = start, 0
        while stop < len(atoms) and (stop == start or total + atoms[stop][1] <= size):
            total += atoms[stop][1]
            stop += 1
        out.append(("".join(("" if glued or k == 0 else " ") + word for k, (word, _, glued) in enumerate(atoms[start:stop])), total))
        if stop == len(atoms):
            break
        back, again = stop, 0
        while back - 1 > start and again + atoms[back - 1][1] <= overlap:
            back -= 1
            again += atoms[back][1]
        start = back
    return out


def shared_length(before: str | None, text: str, reach: int = OVERLAP * REACH) -> int:
    """Characters that end one text and begin the next: the most, none if that is the whole of the next."""
    tail, head = (before or "")[-reach:] if reach else "", text[:reach]
    at = tail.find(head[0]) if head else -1
    while at >= 0:
        if head.startswith(tail[at:]):
            n = len(tail) - at
            return n if n < len(text) else 0
        at = tail.find(head[0], at + 1)
    return 0


def _cut(documents: DataFrame, cut, overlap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part_of in B.parts(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(part_of.column(0).to_pylist(), part_of.column(1).to_pylist(), strict=True):
                before = None
                for k, (part, n) in enumerate(cut(text or "")):
                    for column, value in zip(out, (doc_id, k, part, n, shared_length(before, part, overlap * REACH)), strict=True):
                        column.append(value)
                    before = part
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32())], names=["doc_id", "chunk_index", "text", "token_count", "shared"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CHUNKS)


def simple_chunks(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of all texts, every word counted as one; else as ``chunks``."""
    return _cut(documents, lambda text: word_windows([w for w in _SPACES.split(text) if w], size, overlap), overlap)


def chunks(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks (doc_id, chunk_index, text, token_count, shared) of all texts; ``shared`` characters repeat the chunk before."""
    return _cut(documents, lambda text: windows(text, size, overlap), overlap)


def coalesced(segments: DataFrame) -> DataFrame:
    """Segments (doc_id, seq, text, label, page) with neighbours of equal label and page joined by a blank line."""
    order = W.partitionBy("doc_id").orderBy("seq")
    same = F.lag(F.lit(1)).over(order).isNotNull() & F.lag("label").over(order).eqNullSafe(F.col("label")) & F.lag("page").over(order).eqNullSafe(F.col("page"))
    marked = segments.withColumn("new", (~same).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = marked.groupBy("doc_id", "run").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"), F.first("label").alias("label"), F.first("page").alias("page"))
    return joined.select("doc_id", F.col("seq"), F.array_join("parts.text", "\n\n").alias("text"), "label", "page")


def refused(chunked: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """Documents with more chunks than are indexed."""
    return chunked.groupBy("doc_id").agg(F.count("*").alias("n_chunks")).where(F.col("n_chunks") > most)


def shared_with_previous(chunked: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Stored chunks (doc_id, chunk_index, text, page, section) with ``shared``; chunks of another page or section share nothing."""

    @F.pandas_udf("int")
    def length(before: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([shared_length(b, t or "", overlap * REACH) for b, t in zip(before, text, strict=True)], dtype="int32")

    order = W.partitionBy("doc_id").orderBy("chunk_index")
    same = F.lag("page").over(order).eqNullSafe(F.col("page")) & F.lag("section").over(order).eqNullSafe(F.col("section"))
    rows = chunked.withColumn("_before", F.when(same, F.lag("text").over(order)))
    return rows.withColumn("shared", F.when(F.col("_before").isNull(), 0).otherwise(length("_before", "text"))).drop("_before")


def without_overlap(chunked: DataFrame) -> DataFrame:
    """Chunks without the ``shared`` characters at their beginning and white space behind them."""
    left = F.regexp_replace(F.substr("text", F.col("shared") + 1), f"^{T.SPACE}+", "")
    return chunked.withColumn("text", F.when(F.col("shared") > 0, left).otherwise(F.col("text")))
