"""One-permutation MinHash fingerprints with optimal densification and packed bits.

Every shingle (five words) is hashed once; the leading bits of the hash choose one of
``BINS`` bins and the least value of each bin stays. An empty bin copies the first
non-empty bin on its own fixed pseudo-random probe sequence, so the choice depends on
the bin alone and never on a neighbour's fill. Each bin keeps its ``BITS`` low-order
bits, packed into a hexadecimal string. The likeness of two fingerprints is the share
of equal bins, freed of the ``2 ** -BITS`` accidental matches.

Defined results: a null text is an empty text; the fingerprint of a text without words is
the empty string; two empty fingerprints have likeness 1, an empty and another one 0; a
text with fewer than five words has one shingle, its whole word sequence. Rows that share
a doc_id follow each other in the order of their texts; a null doc_id comes first. The
only document of a table is followed by itself. An empty table gives an empty result.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels, ordering

WIDTH = 5
BINS = 512
BITS = 4
_SHIFT = np.uint64(64 - 9)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    return (kernels.mix(bins.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) >> _SHIFT).astype(np.int64)


def sketches(texts: list[str]) -> np.ndarray:
    """A row of ``BINS`` codes for each text; -1 throughout for a text without words."""
    raw, offsets = kernels.text_buffer(pa.array(texts, pa.large_string()))
    words, before = kernels.word_hashes(raw, offsets, lower=False)
    values, at = kernels.shingle_hashes(words, before, WIDTH)
    least = np.full(len(texts) * BINS, _NONE)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    np.minimum.at(least, owner * BINS + (values >> _SHIFT).astype(np.int64), values)
    least = least.reshape(len(texts), BINS)
    filled = least != _NONE
    out = (kernels.mix(least) & np.uint64((1 << BITS) - 1)).astype(np.int8)
    rows, bins = np.nonzero(~filled & filled.any(1)[:, None])
    attempt = 0
    while len(rows):
        source = _probe(bins, attempt)
        hit = filled[rows, source]
        out[rows[hit], bins[hit]] = out[rows[hit], source[hit]]
        rows, bins, attempt = rows[~hit], bins[~hit], attempt + 1
    out[~filled.any(1)] = -1
    return out


def packed(codes: np.ndarray) -> list[str]:
    """Hexadecimal strings of the packed bits of each row."""
    pairs = (codes[:, ::2].astype(np.uint8) << BITS) | codes[:, 1::2].astype(np.uint8)
    return ["" if codes[i, 0] < 0 else pairs[i].tobytes().hex() for i in range(len(codes))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the estimated Jaccard similarity of two arrays of codes."""
    chance = 2.0**-BITS
    corrected = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0.0, 1.0)
    bare_a, bare_b = a[:, 0] < 0, b[:, 0] < 0
    return np.where(bare_a & bare_b, 1.0, np.where(bare_a | bare_b, 0.0, corrected))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; a row with ``closes`` only ends the range before it."""
    held: tuple | None = None  # the last row so far and its codes
    for block in kernels.blocks(batches, "text"):
        ids, texts, closes = (block.column(block.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "closes"))
        texts = [x or "" for x in texts]
        codes = sketches(texts)
        if held:
            ids, texts, closes, codes = [held[0], *ids], [held[1], *texts], [held[2], *closes], np.vstack([held[3], codes])
        held = ids[-1], texts[-1], closes[-1], codes[-1:]
        own = [i for i in range(len(ids) - 1) if not closes[i]]
        if not own:
            continue
        edited = [_edited(texts[i], texts[i + 1]) for i in own]
        other = sketches(edited)
        at = np.array(own)
        yield pa.record_batch(
            {
                "doc_id": pa.array([ids[i] for i in own], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string()),
                "fingerprint": pa.array(packed(codes[at]), pa.string()),
                "edited_fingerprint": pa.array(packed(other), pa.string()),
                "near_edited": pa.array(likeness(codes[at], other), pa.float64()),
                "near_next": pa.array(likeness(codes[at], codes[at + 1]), pa.float64()),
            }
        )


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint of every text, and its likeness to an edited text and to the next document's.

    The table is cut into ranges of doc_id. Each range gets the first document of the next
    one as a closing row, so no range waits for another and none is read twice.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(ordering.LOWEST))
    parts = ordering.partitions(documents)
    cuts = ordering.cut_points(rows, "doc_id", parts)
    rows = rows.withColumn("part", ordering.range_part(key, cuts)).withColumn("closes", F.lit(False))
    # one number for each range: as many as there are partitions
    heads = sorted(tuple(x) for x in rows.groupBy("part").agg(F.min(key).alias("head")).collect())
    if not heads:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    before = [(heads[i - 1][0] if i else heads[-1][0], head) for i, (_, head) in enumerate(heads)]
    closing = documents.sparkSession.createDataFrame(before, "part int, head long")
    closing = (
        rows.select(key.alias("head"), "text")
        .join(F.broadcast(closing), "head")
        .groupBy("part", "head")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", "part", F.lit(True).alias("closes"))
    )
    ordered = rows.unionByName(closing).repartitionByRange(parts, "part").sortWithinPartitions("part", "closes", F.col("doc_id").asc_nulls_first(), "text")
    return ordered.select("doc_id", "text", "closes").mapInArrow(_compare, SCHEMA)
