"""Quality classifier with supervised subword embeddings.

A document is the mean of the hashed vectors of its words, of its pairs of neighbouring words,
and of the three- to five-byte pieces of its words (white space marks a word's edge). All pairs
of a word with itself share one vector, so that immediate repetition is learned from every word
that shows it. A softmax layer turns the mean into class probabilities; vectors and layer are
learned together by plain stochastic gradient descent in numpy on a bounded sample of labelled
rows. Features of the sample are made where its texts lie, and one task learns from them; the
driver gets the finished weights only.

A trained model is linear in the mean, so for scoring each bucket's vector is folded into
one number, a multiple of ``2 ** -20``: sums of such numbers are exact, so a score does not
depend on what stands beside a text or on how a very long one is cut. Texts are cut at white
space only, and the last word is carried over the cut.

Defined results: a null or empty text has no features and gets the score of the bias
alone. Labels other than 0 and 1 and labels of unknown documents are ignored; a document
with several labels takes part once for each distinct one, and of rows that share a doc_id the
least text is learned from. Without labelled rows of both classes all scores are 0.5. Repeated
rows are scored alike, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import kernels

BITS = 18
BUCKETS = 1 << BITS
#: The bucket of all pairs of a word with itself.
REPEATED = BUCKETS - 1
DIMENSIONS = 8
PIECES = (3, 4, 5)
THRESHOLD = 0.3
#: At most so many labelled rows of each class are used to fit.
SAMPLE_PER_CLASS = 1500
EPOCHS = 6
RATE = 0.5
#: Steps of the folded weights in a whole.
GRAIN = float(1 << 20)

_rng = np.random.Generator(np.random.PCG64(77))
_CODE = _rng.integers(0, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)
_CODE[[9, 10, 11, 12, 13]] = _CODE[32]
_FACTOR = _rng.integers(0, 1 << 32, (6, 6), dtype=np.uint32) | np.uint32(1)
_DOWN = np.uint32(32 - BITS)
_TOP = np.uint64(64 - BITS)


def _features(raw: np.ndarray, offsets: np.ndarray, last: np.uint64 | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features one after another: their buckets and the text that owns each.

    ``last`` is the hash of the word before the first one, where a text is cut.
    """
    n = len(offsets) - 1
    words, before = kernels.word_hashes(raw, offsets, lower=False)
    owner = np.repeat(np.arange(n), np.diff(before))
    yield (words >> _TOP).astype(np.int64), owner
    first, second, own = words[:-1], words[1:], owner[1:]
    inside = own == owner[:-1]
    first, second, own = first[inside], second[inside], own[inside]
    if last is not None and len(words):
        first, second, own = np.insert(first, 0, last), np.insert(second, 0, words[0]), np.insert(own, 0, 0)
    pairs = (kernels.mix(first * np.uint64(3) + second) >> _TOP).astype(np.int64)
    yield np.where(first == second, REPEATED, pairs), own
    # a blank before, between and after the texts
    owner = np.repeat(np.arange(n), np.diff(offsets) + 1)
    spread = np.full(len(raw) + n + 1, 32, dtype=np.uint8)
    spread[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = raw
    blank = np.concatenate([np.zeros(1, np.int32), np.cumsum(kernels._SPACE[spread], dtype=np.int32)])
    code = _CODE[spread]
    for size in PIECES:
        count = len(spread) - size + 1
        if count <= 0:
            continue
        value = np.zeros(count, dtype=np.uint32)
        for j in range(size):
            value += code[j : j + count] * _FACTOR[size, j]
        inner = blank[size - 1 : size - 1 + count] == blank[1 : 1 + count]
        at = np.flatnonzero(inner)
        value = value[at]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        yield (value >> _DOWN).astype(np.int64), owner[at]


def _parts(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a very long text, each ending before white space; a longer word stays whole."""
    blanks = np.flatnonzero(kernels._SPACE[raw])
    at = 0
    while at < len(raw):
        k = int(np.searchsorted(blanks, at + kernels.SEGMENT))
        stop = int(blanks[k]) if k < len(blanks) else len(raw)
        yield raw[at:stop]
        at = stop


def _long_features(raw: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of one text of any length, part by part."""
    last = None
    for part in _parts(raw):
        offsets = np.array([0, len(part)])
        for buckets, _ in _features(part, offsets, last):
            yield buckets
        words, _ = kernels.word_hashes(part, offsets, lower=False)
        last = words[-1] if len(words) else last


def means(raw: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The mean weight of the features of each text; 0 without features. Weights are multiples of 1 / GRAIN."""
    n = len(offsets) - 1
    totals, counts = np.zeros(n), np.zeros(n)
    if n == 1:
        for buckets in _long_features(raw):
            totals += weight[buckets].sum()
            counts += len(buckets)
    else:
        for buckets, owner in _features(raw, offsets):
            totals += np.bincount(owner, weights=weight[buckets], minlength=n)
            counts += np.bincount(owner, minlength=n)
    return totals / np.maximum(counts, 1)


class Model:
    """Weights for each bucket and a bias; the score is their logistic sum."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def probabilities(self, column: pa.Array) -> np.ndarray:
        raw, offsets = kernels.text_buffer(column)
        return 1.0 / (1.0 + np.exp(-np.clip(means(raw, offsets, self.weight) + self.bias, -500, 500)))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and the share of its features in each."""
    raw, _ = kernels.text_buffer(pa.array([text]))
    found = [np.unique(buckets, return_counts=True) for buckets in _long_features(raw)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    buckets, index = np.unique(np.concatenate([b for b, _ in found]), return_inverse=True)
    times = np.bincount(index, weights=np.concatenate([t for _, t in found]), minlength=len(buckets))
    return buckets, (times / max(times.sum(), 1)).astype(np.float32)


def learn(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 5) -> Model:
    """Learn vectors and the output layer by stochastic gradient descent, one document a step."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(bags), 0
    y = np.array(labels)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - done / steps)
            done += 1
            buckets, share = bags[i]
            mean = share @ vectors[buckets]
            scores = mean @ layer + bias
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p * 0.1
            # a bag's mean moves little by each vector, so a vector takes its share many times over
            vectors[buckets] -= (rate * 20) * np.minimum(share, 0.05)[:, None] * back
    weight = np.rint((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64) * GRAIN) / GRAIN
    return Model(weight, float(bias[1] - bias[0]))


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    return learn([bag(t) for t in texts], labels, seed)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` rows of each class, those with the least hash of doc_id.

    One task learns from the features of these rows, 2 * per_class at most; its weights, of a
    fixed size, reach the driver.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = None
    for label in (0, 1):
        own = usable.where(F.col("quality") == label).orderBy(*order).limit(per_class)
        sample = own if sample is None else sample.unionByName(own)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in kernels.blocks(batches, "text"):
            made = [bag(t) for t in block.column(block.schema.get_field_index("text")).to_pylist()]
            yield pa.record_batch({
                **{c: block.column(block.schema.get_field_index(c)) for c in ("doc_id", "quality")},
                "buckets": pa.array([b.astype("<i4").tobytes() for b, _ in made], pa.binary()), "shares": pa.array([s.astype("<f4").tobytes() for _, s in made], pa.binary()),
            })

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, labels = table.column("doc_id").to_pylist(), table.column("quality").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k], labels[k]))
        held = [(np.frombuffer(b.as_buffer(), "<i4"), np.frombuffer(s.as_buffer(), "<f4")) for b, s in zip(table.column("buckets"), table.column("shares"), strict=True)]
        model = learn([held[k] for k in order], [labels[k] for k in order])
        kernels.release()
        return pa.table({"weight": pa.array([model.weight.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([model.bias])})

    made = rows.mapInArrow(bags, "doc_id long, quality int, buckets binary, shares binary")
    found = made.groupBy(F.lit(0).alias("one")).applyInArrow(run, "weight binary, bias double").first()
    return Model(np.frombuffer(found.weight, "<f4").astype(np.float64), found.bias) if found else Model(np.zeros(BUCKETS), 0.0)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with a column ``score``; any column of that name is replaced."""
    kept = [c for c in documents.columns if c != "score"]
    frame = documents.select(*kept)
    schema = T.StructType([*frame.schema.fields, T.StructField("score", T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        own = Model(weight.astype(np.float64), bias)
        for block in kernels.blocks(batches, "text"):
            made = own.probabilities(block.column(block.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(made, pa.float64())], [*block.schema.names, "score"])

    return frame.mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``score`` and ``predicted``, learned from the labels that are not held out."""
    return score(documents, fit(documents, labels)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    names = documents.columns
    return score(documents, fit(documents, labels)).where(F.col("score") >= threshold).select(*names)
