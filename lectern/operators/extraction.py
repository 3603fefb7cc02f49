"""Records that a user's function (a model, say) extracts from chunks, with a marker for each chunk.

The function gets a text and the number of the attempt and gives its reply as text: JSON with an
array of ``{"type", "value"}``, in whatever prose or fences. A reply without a readable array is
asked for once more; of the last reply the whole elements of a cut array are taken. A chunk that no
attempt reads has the marker ``unparsed`` and is tried again in the next run. A chunk is done if it
has the marker ``ok`` for the same text and the same model.

Each distinct text is sent once, and records and markers are joined to every chunk that has it.

Defined results: blank and null texts are not sent and have no marker. Rows that share a chunk_id
each have their own. Values are trimmed, empty ones left out; unknown types are ``generic``.
Errors of the function count as replies that can't be read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Types of records.
TYPES = ("generic", "date", "amount", "party", "obligation")
ATTEMPTS = 2
MARKER, OK, UNPARSED = "__scan__", "ok", "unparsed"
#: Distinct texts whose replies one task of a stream remembers.
REMEMBERED = 10_000
#: Chunk ids whose state a stream keeps together.
TOGETHER = 4096

RECORDS = "doc_id long, chunk_id long, record_type string, value string, normalized string, content_hash string, model string"
_DECODER = json.JSONDecoder()


def whole_elements(text: str) -> list | None:
    """The elements of a JSON array up to where it is cut or broken; None if no element is whole. Linear in the text."""
    at, out = 1, []
    while at < len(text):
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            element, at = _DECODER.raw_decode(text, at)
        except ValueError:
            break
        out.append(element)
    while out and not isinstance(out[-1], dict):
        out.pop()  # what ends in a cut may be part of a longer number or word
    return out or None


def read_reply(reply: str | None, salvage: bool = False) -> list[tuple[str, str]] | None:
    """(type, value) pairs of a reply, None if it has no readable array.

    The array reaches from the first ``[`` to the last ``]``. ``salvage`` takes the whole elements
    of one that is cut off. An empty array is read, and has nothing.
    """
    if not isinstance(reply, str) or "[" not in reply:
        return None
    start, end = reply.index("["), reply.rindex("]") if "]" in reply else -1
    found = None
    if end > start:
        try:
            found = json.loads(reply[start : end + 1])
        except ValueError:
            found = None
    if not isinstance(found, list) and salvage:
        found = whole_elements(reply[start:])
    if not isinstance(found, list):
        return None
    out = []
    for one in found:
        value = one.get("value") if isinstance(one, dict) else None
        value = value.strip() if isinstance(value, str) else ""
        if value:
            kind = one.get("type")
            kind = kind.lower().strip() if isinstance(kind, str) else ""
            out.append((kind if kind in TYPES else "generic", value))
    return out


def attempted(text: str, extract: Callable[[str, int], str | None], attempts: int = ATTEMPTS) -> list[tuple[str, str]] | None:
    """The pairs of the first reply that can be read."""
    for k in range(1, attempts + 1):
        try:
            reply = extract(text, k)
        except Exception:  # the function is the user's: its failure is the chunk's marker, and the next run tries again
            reply = None
        found = read_reply(reply, salvage=k == attempts)
        if found is not None:
            return found
    return None


def _normalized(value: str) -> str:
    return " ".join(value.lower().split())


def _rows(found: list[tuple[str, str]] | None) -> list[tuple[str, str, str]]:
    marker = UNPARSED if found is None else OK
    return [(MARKER, "", marker), *((kind, value, _normalized(value)) for kind, value in found or ())]


def _whole(number: str | None) -> int | None:
    return None if number is None else int(number)


def _with_hash(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_id").cast("long").alias("chunk_id"), "text", T.content_hash(F.col("text")).alias("content_hash"), *more)


def scanned(chunks: DataFrame, extract: Callable[[str, int], str | None], model: str, earlier: DataFrame | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """Markers and records of the chunks that have no ``ok`` marker for their text and this model in ``earlier``."""
    left = _with_hash(chunks)
    if earlier is not None:
        done = earlier.where((F.col("record_type") == MARKER) & (F.col("normalized") == OK) & (F.col("model") == model)).select("chunk_id", "content_hash").distinct()
        left = left.join(done, ["chunk_id", "content_hash"], "left_anti")
    texts = left.groupBy("content_hash").agg(F.min("text").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, *row) for key, text in zip(frame.content_hash, frame.text, strict=True) for row in _rows(attempted(text, extract, attempts))]
            yield pd.DataFrame(rows, columns=["content_hash", "record_type", "value", "normalized"])

    found = texts.mapInPandas(run, "content_hash string, record_type string, value string, normalized string")
    both = left.drop("text").join(found, "content_hash")
    return both.select("doc_id", "chunk_id", "record_type", "value", "normalized", "content_hash", F.lit(model).alias("model"))


def merged(earlier: DataFrame, new: DataFrame) -> DataFrame:
    """The records after a run: a chunk that was scanned anew has its new rows alone."""
    return earlier.join(new.where(F.col("record_type") == MARKER).select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(new)


def scanned_stream(chunks: DataFrame, extract: Callable[[str, int], str | None], model: str, attempts: int = ATTEMPTS) -> DataFrame:
    """The same for a stream: keyed state holds the text that each chunk was read with, so a batch costs what it brings.

    Rows have a number ``scan`` that goes up whenever a chunk is scanned anew; ``current`` takes the
    last ones. A task sends equal texts of a batch once, while it remembers them. Chunks of a run of
    ``TOGETHER`` ids are a group with one state, since a call for each chunk would cost more than its
    reading. Where a batch may bring a chunk twice, a column ``arrived`` tells the order.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = {chunk: (digest, number) for chunk, digest, number in zip(*state.get, strict=True)} if state.exists else {}
        frame, rows = pd.concat(frames), []
        if frame.arrived.nunique() > 1:
            frame = frame.sort_values("arrived", kind="stable")
        for doc, chunk, text, digest in zip(frame.doc_id, frame.chunk_id, frame.text, frame.content_hash, strict=True):
            doc, chunk = _whole(doc), _whole(chunk)
            before, number = known.get(chunk, ("", 0))
            if digest == before:
                continue
            if digest not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[digest] = attempted(text, extract, attempts)
            found, number = memory[digest], number + 1
            known[chunk] = (digest if found is not None else "", number)
            rows += [(doc, chunk, kind, value, norm, digest, model, number) for kind, value, norm in _rows(found)]
        state.update((list(known), [digest for digest, _ in known.values()], [number for _, number in known.values()]))
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "record_type", "value", "normalized", "content_hash", "model", "scan"], dtype=object)

    memory: dict[str, list | None] = {}
    if "arrived" not in chunks.columns:
        chunks = chunks.withColumn("arrived", F.lit(""))
    # ids go as text: beside a null pandas would round them
    rows = _with_hash(chunks, "arrived").select(F.shiftright("chunk_id", TOGETHER.bit_length() - 1).alias("run"), F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "text", "content_hash", "arrived")
    return rows.groupBy("run").applyInPandasWithState(run, f"{RECORDS}, scan long", "chunks array<long>, hashes array<string>, scans array<long>", "append", "NoTimeout")


def current(records: DataFrame) -> DataFrame:
    """The rows of each chunk's last scan."""
    last = records.where(F.col("record_type") == MARKER).groupBy("chunk_id").agg(F.max("scan").alias("scan"))
    return records.join(last, ["chunk_id", "scan"], "left_semi").drop("scan")
