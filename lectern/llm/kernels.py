"""Array kernels that turn a column of texts into word and shingle hashes.

They run inside Spark tasks on Arrow batches. Words are the maximal runs of bytes
outside ``\\x20 \\x09-\\x0D``; hashes are 64 bits wide. A text is read in segments of
about ``SEGMENT`` bytes, so memory follows the segment and the number of words, never
the length of the longest text times eight. Words of more than ``LONG`` bytes are hashed one
by one, since the sums used for short ones have known collisions at greater lengths.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
#: Bytes of the longest word that is hashed together with others.
LONG = 256
#: Bytes of text that one step of an operator handles at once.
BLOCK = 1 << 20

# Python workers live on from stage to stage: what one frees goes back to the system
pa.set_memory_pool(pa.system_memory_pool())

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which near values land far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(max(n, SEGMENT + 1024), base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64) if len(at) else np.zeros(1, np.int64)
    low, high = int(at[0]), int(at[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return raw, at - low


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of ``column`` each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffer(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + size, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Give what numpy has freed back to the system, where the C library can: Python workers live on from stage to stage."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def segment_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of the bytes in each ascending, disjoint range ``[start, end)``."""
    out = np.empty(len(starts), dtype=np.uint64)
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        import xxhash

        short = np.flatnonzero(ends - starts <= LONG)
        out[short] = segment_hashes(raw, starts[short], ends[short], lower)
        for k in long.tolist():
            word = raw[starts[k] : ends[k]].tobytes()
            out[k] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
        return out
    table, done = _LOWER_BYTE if lower else _BYTE, 0
    while done < len(starts):
        low = int(starts[done])
        upto = max(done + 1, int(np.searchsorted(ends, low + SEGMENT, side="right")))
        high = int(ends[upto - 1])
        power, inverse = _power(high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.multiply(table[raw[low:high]], power[: high - low], out=sums[1:])
        np.cumsum(sums, out=sums)
        a, b = starts[done:upto] - low, ends[done:upto] - low
        out[done:upto] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * _PLACE[15]
        done = upto
    return mix(out)


def word_ranges(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it. ``apart``: bytes outside words."""
    inside = ~apart[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of words before it."""
    starts, ends, before = word_ranges(raw, offsets)
    return segment_hashes(raw, starts, ends, lower), before


def shingle_hashes(words: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words; a text with fewer words is one run, without words none."""
    counts = np.diff(before)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(made)])
    total = int(at[-1])
    where = np.arange(total) - np.repeat(at[:-1] - before[:-1], made)
    size = np.repeat(np.minimum(counts, width), made)
    out = size.astype(np.uint64) * _PLACE[14]
    for j in range(width):
        use = size > j
        if use.all():
            out += words[where + j] * _PLACE[j]
        else:
            out[use] += words[where[use] + j] * _PLACE[j]
    return mix(out), at


def shingle_sets(column: pa.Array, width: int, lower: bool) -> list[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order."""
    raw, offsets = text_buffer(column)
    words, before = word_hashes(raw, offsets, lower)
    values, at = shingle_hashes(words, before, width)
    return [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
