"""Keyword and vector search, rank fusion, and the trim to a context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from lectern.functions import batches as in_batches
from lectern.functions import text as T
from lectern.operators import budgets

K1, B = 1.2, 0.75
RRF = 60
CANDIDATES = 12
FINAL = 6
BUDGET = 2500
MARGIN = 1.3


def bm25(chunks: DataFrame, question: str, key: str = "chunk_id") -> DataFrame:
    """BM25 scores (key, score) of the chunks that hold a term of the question.

    Statistics come from all chunks given; a term that the question repeats counts as often. One
    pass gathers one row of totals, with how many chunks hold each of the question's terms (32 at
    most); a second one scores chunk by chunk, so no chunk is shuffled.
    """
    asked = [r.term for r in chunks.sparkSession.range(1).select(F.explode(T.query_terms(F.lit(question))).alias("term")).collect()]
    times = {t: asked.count(t) for t in sorted(set(asked))}
    # only the question's terms are taken out of a text; all others are counted where they stand
    wanted = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(times) or '(?!)'})(?![\p{{L}}\p{{N}}])"
    low = chunks.select(key, F.lower("text").alias("low"))
    rows = low.select(key, F.regexp_count("low", F.lit(r"[\p{L}\p{N}]+")).cast("long").alias("dl"), F.coalesce(F.regexp_extract_all("low", F.lit(wanted), F.lit(0)), F.array().cast("array<string>")).alias("hits"))
    totals = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("average"), *(F.sum(F.array_contains("hits", t).cast("long")).alias(f"df{i}") for i, t in enumerate(times)))
    scored = rows.where(F.size("hits") > 0).crossJoin(F.broadcast(totals))  # one row of totals
    score = F.lit(0.0)
    for i, (term, n) in enumerate(times.items()):
        tf, df = F.size(F.filter("hits", _equals(term))), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        part = n * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("average")))
        score = score + F.when(tf > 0, F.round(part, 9)).otherwise(0.0)
    return scored.select(key, F.round(score, 6).alias("score"))


def _equals(term: str):
    return lambda t: t == term


class Index:
    """A stored inverted index: postings dealt by term, and one row of totals.

    A question reads the parts of its own terms only, whatever the number of chunks.
    """

    #: Characters of text for each part of the postings, and parts at most.
    PART, MOST = 1 << 22, 4096

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, chunks: DataFrame, path: str, key: str = "chunk_id") -> Index:
        """Texts are read twice: for their lengths, which tell how many parts there are, and for their terms."""
        size = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
        parts = max(1, min(cls.MOST, size.chars // cls.PART))
        cls.postings(chunks, parts, key).sortWithinPartitions("part", "term").drop("slot").write.partitionBy("part").parquet(f"{path}/postings")
        chunks.sparkSession.read.schema("tf long").parquet(f"{path}/postings").agg(F.lit(size.n).cast("long").alias("n"), (F.coalesce(F.sum("tf"), F.lit(0)) / max(size.n, 1)).alias("average"), F.lit(parts).alias("parts")).write.parquet(f"{path}/totals")
        return cls(chunks.sparkSession, path)

    @staticmethod
    def postings(chunks: DataFrame, parts: int, key: str = "chunk_id") -> DataFrame:
        """Postings (part, slot, chunk_id, term, tf, dl): a text's terms are counted where it stands, and dealt once."""
        kind = chunks.schema[key].dataType.simpleString()

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_batches.parts(batches, "terms"):
                terms = batch.column("terms")
                rows = pa.table({"row": np.repeat(np.arange(len(terms)), pc.list_value_length(terms)), "term": pc.list_flatten(terms)}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
                at = rows.column("row").combine_chunks()
                whole = pa.table([batch.column("chunk_id").take(at), batch.column("dl").take(at), rows.column("term"), rows.column("count_all")], ["chunk_id", "dl", "term", "tf"])
                yield from whole.combine_chunks().to_batches()

        rows = chunks.select(F.col(key).alias("chunk_id"), F.explode(F.array(T.terms(F.col("text")))).alias("terms")).where(F.size("terms") > 0)
        terms = rows.select("chunk_id", F.size("terms").cast("long").alias("dl"), "terms").mapInArrow(counted, f"chunk_id {kind}, dl long, term string, tf long")
        # a frequent term is spread over several files of its part; rows of one chunk_id meet in its slot
        placed = terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).withColumn("slot", F.pmod(F.xxhash64("chunk_id"), F.lit(8)))
        return placed.repartition("part", "slot").groupBy("part", "slot", "chunk_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))

    def scores(self, question: str) -> DataFrame:
        """The same scores as ``bm25``."""
        totals = self.spark.read.parquet(f"{self.path}/totals")
        parts = totals.first().parts
        asked = self.spark.range(1).select(F.explode(T.query_terms(F.lit(question))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
        found = asked.select("term", "times", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")).collect()  # 32 at most
        hits = self.spark.read.parquet(f"{self.path}/postings").where(F.col("part").isin(sorted({r.part for r in found})) & F.col("term").isin([r.term for r in found])).drop("part")
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        rows = hits.join(F.broadcast(df), "term").join(F.broadcast(asked), "term").crossJoin(F.broadcast(totals))  # 32 rows and one
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("average")))
        return rows.groupBy("chunk_id").agg(F.round(F.sum(F.round(part, 9)), 6).alias("score"))


def top(scored: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The k best rows, ties by key."""
    return scored.orderBy(F.col("score").desc(), F.col(key)).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is zero, null where lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), None).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def similar(vectors: DataFrame, question: list[float], key: str = "chunk_id", floor: float | None = None, most: int | None = None) -> DataFrame:
    """Scores (key, score) of the vectors of the question's length by cosine, a matrix product for each Arrow batch.

    0 where a vector is zero, null where one holds a null. ``most`` keeps of each batch what can be
    among so many best, ties included, so that little goes on to the final order.
    """
    asked = np.asarray(question, np.float64)
    norm = float(np.sqrt(asked @ asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, len(asked))
            lengths = np.sqrt(np.einsum("ij,ij->i", made, made)) * norm
            score = np.divide(made @ asked, lengths, out=np.zeros(len(made)), where=lengths != 0)
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, mask=np.isnan(score))], [key, "raw"])
            if most is not None and batch.num_rows > most:
                least = -np.partition(-np.nan_to_num(score, nan=-2.0), most - 1)[most - 1]
                rows = rows.filter(pa.array(np.nan_to_num(score, nan=-2.0) >= least - 1e-6))
            yield rows

    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.where(F.size("embedding") == len(question)).select(key, "embedding").mapInArrow(run, f"{key} {kind}, raw double").select(key, F.round("raw", 6).alias("score"))
    return rows if floor is None else rows.where(F.col("score") >= floor)


def hash_embedding(chunks: DataFrame, key: str = "chunk_id", dimensions: int = 384) -> DataFrame:
    """Sparse hash embedding (key, position, weight): six signed positions for each term.

    Six groups of five bytes of a term's SHA-256 give a position (a big-endian number modulo
    the dimensions) and, by the lowest bit of the fifth byte, a sign.
    """
    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit("([a-z0-9]+)"), F.lit(1))
    rows = chunks.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    # each distinct term is hashed once
    hashed = rows.select("term").distinct().withColumn("h", F.sha2("term", 256))
    at = lambda k: F.struct((F.conv(F.substring("h", 10 * k + 1, 8), 16, 10).cast("long") % dimensions).alias("position"), F.when(F.conv(F.substring("h", 10 * k + 10, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1).alias("sign"))
    places = hashed.select("term", F.explode(F.array(*[at(k) for k in range(6)])).alias("p")).select("term", "p.*")
    return rows.join(places, "term").groupBy(key, "position").agg(F.sum(F.col("tf") * F.col("sign")).alias("weight")).where("weight <> 0")


class _Places:
    """Positions and signs of terms, each distinct term hashed once; one lives in each task."""

    MOST = 1 << 18

    def __init__(self, dimensions: int):
        self.dimensions, self.number = dimensions, {}
        self.at, self.sign = np.zeros((1024, 6), np.int64), np.zeros((1024, 6), np.int64)

    def of(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > self.MOST:
            self.number.clear()
        ids = np.empty(len(terms), np.int64)
        for i, term in enumerate(terms):
            k = self.number.get(term)
            if k is None:
                k = self.number[term] = len(self.number)
                if k >= len(self.at):
                    self.at, self.sign = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.sign))
                digest = np.frombuffer(hashlib.sha256(term.encode()).digest()[:30], np.uint8).reshape(6, 5)
                self.at[k] = digest[:, :4].copy().view(">u4").ravel().astype(np.int64) % self.dimensions
                self.sign[k] = np.where(digest[:, 4] % 2 == 1, 1, -1)
            ids[i] = k
        return self.at[ids], self.sign[ids]

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """A row of whole numbers for each text."""
        found = [_HASHED_TERM.findall((t or "").lower()) for t in texts]
        at, sign = self.of([w for words in found for w in words])
        row = np.repeat(np.arange(len(texts)), [len(words) for words in found])
        flat = np.bincount((row[:, None] * self.dimensions + at).ravel(), weights=sign.ravel(), minlength=len(texts) * self.dimensions)
        return flat.reshape(len(texts), self.dimensions)


_HASHED_TERM = re.compile("[a-z0-9]+")


def hash_similar(chunks: DataFrame, question: str, key: str = "chunk_id", dimensions: int = 384) -> DataFrame:
    """Scores (key, score) by the cosine of hash embeddings, chunk by chunk; a chunk whose embedding is zero has none."""
    asked = _Places(dimensions).vectors([question])[0]
    norm = float(np.sqrt(asked @ asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(dimensions)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                made = places.vectors(part.column(1).to_pylist())
                own = np.sqrt((made * made).sum(1))
                good = own > 0
                score = np.divide(made @ asked, own * norm, out=np.full(len(own), np.nan), where=good & (norm > 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, mask=np.isnan(score))], [key, "raw"]).filter(pa.array(good))

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, "text").mapInArrow(run, f"{key} {kind}, raw double").select(key, F.round("raw", 6).alias("score"))


def ranked(hits: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The k best hits with their rank from 1; the window sees k rows."""
    return top(hits, k, key).withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), F.col(key))))


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, key: str = "chunk_id", constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: key, rrf, best_rank, cosine."""
    v = vector_hits.select(key, F.col("rank").alias("v_rank"), F.col("score").alias("cosine"))
    k = keyword_hits.select(key, F.col("rank").alias("k_rank"))
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return v.join(k, key, "full_outer").select(key, F.round(part("v_rank") + part("k_rank"), 9).alias("rrf"), F.least("v_rank", "k_rank").alias("best_rank"), "cosine")


def one_per_page(candidates: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Of candidates (doc_id, page, key, rank) on the same page of a document the best; without a page each stays."""
    place = F.coalesce(F.concat(F.lit("p"), F.col("page").cast("string")), F.concat(F.lit("c"), F.col(key).cast("string")))
    first = F.row_number().over(W.partitionBy("doc_id", place).orderBy("rank"))
    return candidates.withColumn("_n", first).where("_n = 1").drop("_n")


def within_budget(candidates: DataFrame, budget: int = BUDGET, final: int = FINAL, by: tuple[str, ...] = ()) -> DataFrame:
    """The leading candidates until the first that doesn't fit: the first always, at most ``final``, with labels."""
    order = W.partitionBy(*by).orderBy("rank")
    cost = F.ceil(F.col("token_count") * MARGIN).cast("long")
    rows = candidates.withColumn("place", F.row_number().over(order)).withColumn("spent", F.sum(cost).over(order.rowsBetween(W.unboundedPreceding, 0)))
    kept = rows.where(((F.col("place") == 1) | (F.col("spent") <= budget)) & (F.col("place") <= final))
    return kept.withColumn("label", F.concat(F.lit("S"), F.col("place").cast("string")))


def retrieve(chunks: DataFrame, question: str, candidates: int = CANDIDATES, final: int = FINAL, budget: int = BUDGET, floor: float = 0.0) -> DataFrame:
    """Hybrid retrieval over chunks (chunk_id, doc_id, page, text, token_count): the cited passages.

    Vector and keyword hits are fused by rank, one passage a page stays, and passages are
    taken in order until the budget is spent. The score shown is the cosine, or the fused
    score for passages that only the keywords found.
    """
    by_vector = ranked(hash_similar(chunks, question).where(F.col("score") >= floor), candidates)
    by_words = ranked(bm25(chunks, question), candidates)
    fused = fuse(by_vector, by_words)
    order = W.orderBy(F.col("rrf").desc(), "best_rank", "chunk_id")  # two dozen rows
    placed = fused.withColumn("rank", F.row_number().over(order))
    rows = placed.join(chunks.select("chunk_id", "doc_id", "page", "token_count", "text"), "chunk_id")
    kept = within_budget(one_per_page(rows), budget, final)
    return kept.select("label", "chunk_id", "doc_id", "page", F.coalesce("cosine", "rrf").alias("score"), "rrf", T.snippet(F.col("text")).alias("snippet"))


def reranked(candidates: DataFrame, scores: DataFrame | None, key: str = "chunk_id") -> DataFrame:
    """Candidates (key, rank, score) in the order of a second scorer's scores (key, second), ties by the rank before.

    Those that it did not score follow in their own order with their own score; without scores nothing changes.
    """
    if scores is None:
        return candidates
    rows = candidates.join(scores, key, "left")
    order = W.orderBy(F.col("second").desc_nulls_last(), "rank")  # a dozen candidates
    return rows.withColumn("score", F.coalesce("second", "score")).withColumn("rank", F.row_number().over(order)).drop("second")


def encoded(vector: Column) -> Column:
    """A vector as the bytes of little-endian single-precision numbers, in base 64."""
    return F.replace(F.base64(_bytes(vector)), F.lit("\r\n"), F.lit(""))


@F.pandas_udf(BinaryType())
def _bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def _numbers(data: pd.Series, count: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or n is None or len(d) != 4 * n else np.frombuffer(d, "<f4") for d, n in zip(data, count, strict=True)])


def decoded(text: Column, dimensions: Column) -> Column:
    """The vector of stored bytes; null where they aren't as many as it has dimensions."""
    return _numbers(F.unbase64(text), dimensions.cast("int"))


def node_search(nodes: DataFrame, question: str, k: int = CANDIDATES) -> DataFrame:
    """The summary nodes (node_id, text) nearest to a question by hash embedding."""
    return top(hash_similar(nodes, question, "node_id"), k, "node_id")


def whole_pair(chunks: DataFrame, pairs: DataFrame, budget: int) -> DataFrame:
    """Both documents of each pair (pair_id, a, b) read from the beginning: labels run on from a to b, each within its share of the budget.

    ``chunks`` has doc_id, chunk_index, token_count. A document's first chunk is always there.
    """
    sums = chunks.groupBy("doc_id").agg(F.sum(F.ceil(F.col("token_count") * MARGIN)).cast("long").alias("_sum"))
    sized = pairs.join(sums.select(F.col("doc_id").alias("a"), F.col("_sum").alias("_a")), "a").join(sums.select(F.col("doc_id").alias("b"), F.col("_sum").alias("_b")), "b")
    first, second = budgets.split_budget(F.col("_a"), F.col("_b"), F.lit(budget))
    sides = sized.select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("doc_id"), first.alias("share")), F.struct(F.lit(1).alias("side"), F.col("b").alias("doc_id"), second.alias("share")))).alias("s")).select("pair_id", "s.*")
    order = W.partitionBy("pair_id", "side").orderBy("chunk_index")
    rows = sides.join(chunks, "doc_id").withColumn("_n", F.row_number().over(order)).withColumn("_spent", F.sum(F.ceil(F.col("token_count") * MARGIN)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    kept = rows.where((F.col("_n") == 1) | (F.col("_spent") <= F.col("share")))
    label = F.row_number().over(W.partitionBy("pair_id").orderBy("side", "chunk_index"))
    return kept.select("pair_id", "side", "doc_id", "chunk_index", F.concat(F.lit("S"), label.cast("string")).alias("label"))
