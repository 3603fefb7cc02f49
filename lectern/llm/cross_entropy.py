"""Cross-entropy difference of documents between a target and a background model.

Both models are bigram models over words, smoothed into a unigram model:

    p(w)     = (c(w) + ALPHA) / (N + ALPHA * V)
    p(w | h) = (c(h, w) + MU * p(w)) / (c(h) + MU)

where the history of a document's first word is its beginning and ``V`` is fixed. Words,
histories and pairs are counted by 64-bit hashes in tables that grow with the vocabulary. The
background counts all documents, the target those of the documents marked as such; a document
that a model has counted is scored without its own counts. A token's loss is ``-ln p(w | h)``;
a document's score is the mean over its tokens of target loss less background loss. The lower
it is, the more the document is like the target.

1. The documents are dealt into chunks of about ``CHUNK`` bytes of text by a hash of their id and text.
2. Each chunk asks for the counts of its distinct keys, with how often it has them itself and in
   its target documents. The requests are packed by leading bits of the keys into parts, whose
   number grows with the input. A key has one request in a chunk at most, so a frequent one is
   no larger than others.
3. A part adds up its requests and replies to each chunk with both models' counts in the order
   of the keys asked for.
4. A chunk's documents are scored with its replies.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document without
words, a null one too, has 0 tokens and null losses and score. Rows that share a doc_id are
documents of their own; a null doc_id is never in the target. Without a target all target
probabilities are those of the smoothing alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels, shared

#: Words that the smoothing allows for.
V = 1 << 20
ALPHA = 0.1
MU = 64.0
CHUNK = 1 << 23
#: Tokens of the input for each part of the keys.
PART = 1 << 20
_BEGIN = np.uint64(0x5851F42D4C957F2D)
_WORD = np.uint64(0xD1B54A32D192ED03)

SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
_REQUESTS = "part long, chunk long, keys binary, times binary"
_REPLIES = "part long, chunk long, counts binary"


def _events(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of the texts in ascending order; places of each token's word, history and pair among them; texts' token offsets."""
    raw, offsets = kernels.text_buffer(column)
    words, before = kernels.word_hashes(raw, offsets, lower=True)
    history = np.empty_like(words)
    history[1:] = words[:-1]
    history[before[:-1][np.diff(before) > 0]] = _BEGIN
    pair = kernels.mix(words * np.uint64(3) + kernels.mix(history))
    keys, index = np.unique(np.concatenate([kernels.mix(words ^ _WORD), kernels.mix(history ^ _WORD), pair]), return_inverse=True)
    return keys, *np.split(index, 3), before


def _packed(values: np.ndarray) -> bytes:
    """The numbers' bytes, all leading ones first, which shuffles and files compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T[::-1]).tobytes()


def _unpacked(data: pa.Buffer, dtype: type, width: int = 1) -> np.ndarray:
    """A number or a row of ``width`` numbers for each entry."""
    planes = np.frombuffer(data, np.uint8).reshape(width * np.dtype(dtype).itemsize, -1)
    out = np.ascontiguousarray(planes[::-1].T).view(dtype)
    return out if width > 1 else out.ravel()


def _requests(column: pa.Array, marked: np.ndarray, chunk: int, bits: int) -> pa.Table:
    """The distinct keys of the texts, a row for each part of 2 ** bits.

    A key's times are four: as a word or pair and as a history, of all texts and of the marked ones.
    """
    keys, word, past, pair, before = _events(column)
    inside = np.repeat(marked, np.diff(before))
    count = lambda *places: sum(np.bincount(x, minlength=len(keys)) for x in places)
    times = np.stack([count(word, pair), count(past), count(word[inside], pair[inside]), count(past[inside])], axis=1).astype(np.uint32)
    edges = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else 0, len(keys))
    used = np.flatnonzero(np.diff(edges))
    spans = [slice(edges[k], edges[k + 1]) for k in used]
    return pa.table({
        "part": pa.array(used, pa.int64()), "chunk": pa.array([chunk] * len(used), pa.int64()),
        "keys": pa.array([_packed(keys[x]) for x in spans], pa.binary()), "times": pa.array([_packed(times[x]) for x in spans], pa.binary()),
    })


def _replies(key: tuple, table: pa.Table) -> pa.Table:
    """The counts of the keys that each chunk has asked for in a part."""
    asked = [_unpacked(x.as_buffer(), np.uint64) for x in table.column("keys")]
    at = np.concatenate([[0], np.cumsum([len(x) for x in asked])])
    keys, index = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.zeros((len(keys), 4), np.int64)
    for k, times in enumerate(table.column("times")):  # a chunk has a key once
        counts[index[at[k] : at[k + 1]]] += _unpacked(times.as_buffer(), np.uint32, 4)
    given = [_packed(counts[index[low:high]]) for low, high in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"part": pa.array([key[0].as_py()] * len(given), pa.int64()), "chunk": table.column("chunk"), "counts": pa.array(given, pa.binary())})


def _sizes(documents: DataFrame) -> DataFrame:
    """The documents' numbers of tokens and of bytes, without their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in kernels.blocks(batches, "text"):
            raw, offsets = kernels.text_buffer(block.column(block.schema.get_field_index("text")))
            n = np.diff(kernels.word_ranges(raw, offsets)[2])
            yield pa.RecordBatch.from_arrays([*(block.column(block.schema.get_field_index(c)) for c in ("doc_id", "deal")), pa.array(n, pa.int64()), pa.array(np.diff(offsets), pa.int64())], ["doc_id", "deal", "n_tokens", "n_bytes"])

    return documents.mapInArrow(run, "doc_id long, deal long, n_tokens long, n_bytes long")


def _own(owner: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """How often each token's slot, a number below 2 ** 32, occurs in its own document."""
    _, inverse, times = np.unique((owner << 32) | slot, return_inverse=True, return_counts=True)
    return times[inverse]


def losses(column: pa.Array, counts: np.ndarray, totals: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its tokens, its target loss if the target has counted it and if not, and its background loss.

    ``counts`` has the four counts of each distinct key of the texts, in ascending order of the keys.
    """
    _, word, past, pair, before = _events(column)
    size = np.diff(before)
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    own_word, own_past, own_pair, own_size = _own(owner, word), _own(owner, past), _own(owner, pair), size[owner]
    means = []
    for k, counted in ((0, True), (0, False), (1, True)):
        at, less = 2 - 2 * k, float(counted)
        c_pair, c_word, c_past = counts[pair, at] - less * own_pair, counts[word, at] - less * own_word, counts[past, at + 1] - less * own_past
        if k == 0 and counted:  # a text that the target lacks has no counts of its own there
            c_pair, c_word, c_past = (np.maximum(c, 0) for c in (c_pair, c_word, c_past))
        total = np.maximum(totals[k] - less * own_size, 0)
        p_word = (c_word + ALPHA) / (total + ALPHA * V)
        loss = -np.log((c_pair + MU * p_word) / (c_past + MU))
        means.append(np.bincount(owner, weights=loss, minlength=n) / np.maximum(size, 1))
    return size, means[0], means[1], means[2]


def score(documents: DataFrame, target: DataFrame) -> DataFrame:
    """Losses and score of every document; ``target`` names the target's documents by doc_id.

    Every document is scored as if it were in the target and as if it were not, and a join of
    these few numbers with the names chooses.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = target.select(F.col("doc_id").cast("long").alias("_id")).where(F.col("_id").isNotNull()).distinct()
    dealt = rows.withColumn("deal", F.xxhash64("doc_id", "text"))
    sizes = shared.written(_sizes(dealt), "sizes")
    members = sizes.join(ids.hint("merge"), F.col("doc_id") == F.col("_id"))
    total = lambda frame: frame.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_bytes"))).first()
    (n_target, _), (n_all, n_bytes) = total(members), total(sizes)
    bits = (max(n_all - 1, 0) // PART).bit_length()
    chunk = F.pmod("deal", F.lit(n_bytes // CHUNK + 1)).alias("chunk")
    texts = dealt.select(chunk, "doc_id", "text").groupBy("chunk")
    marks = members.select(chunk, "doc_id").distinct().groupBy("chunk")

    def ask(key: tuple, table: pa.Table, marked: pa.Table) -> pa.Table:
        inside = pc.is_in(table.column("doc_id"), marked.column("doc_id")) if marked.num_rows else pa.array([False] * table.num_rows)
        return _requests(table.column("text"), np.array(inside.to_pylist(), dtype=bool), key[0].as_py(), bits)

    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        counts = np.concatenate([np.zeros((0, 4), np.int64), *(_unpacked(x.as_buffer(), np.int64, 4) for x in replies.sort_by("part").column("counts"))])
        size, inside, outside, background = losses(table.column("text"), counts, (n_target, n_all))
        return pa.table({"doc_id": table.column("doc_id"), "n_tokens": pa.array(size, pa.int64()), **{c: pa.array(x, pa.float64(), mask=size == 0) for c, x in (("inside", inside), ("outside", outside), ("background_loss", background))}})

    asked = texts.cogroup(marks).applyInArrow(ask, _REQUESTS)
    replies = asked.groupBy("part").applyInArrow(_replies, _REPLIES)
    scored = texts.cogroup(replies.groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, inside double, outside double, background_loss double")
    # rows without an id meet no name and are spread over all tasks
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("n_tokens", "background_loss"), F.lit(1 << 20))).otherwise(0)
    names = ids.withColumn("_spread", F.lit(0).cast("long"))
    chosen = scored.withColumn("spread", spread.cast("long")).join(names.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.col("spread") == F.col("_spread")), "left")
    target_loss = F.when(F.col("_id").isNotNull(), F.col("inside")).otherwise(F.col("outside"))
    return chosen.select("doc_id", "n_tokens", target_loss.alias("target_loss"), "background_loss", (target_loss - F.col("background_loss")).alias("score"))
