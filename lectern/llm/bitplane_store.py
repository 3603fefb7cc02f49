"""Token ids in files of shuffled planes.

Ids stand in blocks of ``BLOCK`` ids. A block is transposed into byte planes (or, by
parameter, bit planes): first the lowest byte of every id, then the next, up to the highest
that is not zero throughout. Each plane is compressed with zstandard on its own. A file is

    b"LPLN" | version | plane kind | planes of block 0 | planes of block 1 | ... | index | length of index | b"LPLN"

and its chunk index has for each block the offset, the number of ids and the compressed
length of each plane. Documents follow each other in ascending doc_id order, across the
files in part order; a document may begin and end anywhere within a block.

Every attempt of a task writes a file of its own name in the folder. The catalogue, one row
a document, is written by Spark, which commits one attempt of each task; a file that no
committed row names is not part of the store, so lost executors and repeated tasks do no
harm. Files are written and read through Arrow's file systems by URI.

Defined results: a null text is an empty text and has the end id alone. Rows that share a
doc_id follow each other in the order of their texts; a null doc_id comes first. An empty
table gives a store without documents. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import kernels, ordering, shared, token_ids

MAGIC = b"LPLN"
VERSION = 1
BLOCK = 1 << 16
CATALOGUE = "doc_id long, part int, file string, start long, n_tokens long"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def pack_block(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The compressed planes of a block, the lowest first."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    top = int(ids.max(initial=0)).bit_length()
    data = np.ascontiguousarray(ids, dtype="<u4")
    if bits:
        return [pack(np.packbits(((data >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes()) for k in range(max(top, 1))]
    lanes = data.view(np.uint8).reshape(-1, 4)
    return [pack(np.ascontiguousarray(lanes[:, k]).tobytes()) for k in range(max((top + 7) // 8, 1))]


def unpack_block(planes: list[bytes], count: int, bits: bool = False) -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    if bits:
        out = np.zeros(count, np.uint32)
        for k, plane in enumerate(planes):
            out |= np.unpackbits(np.frombuffer(unpack(plane), np.uint8), count=count, bitorder="little").astype(np.uint32) << np.uint32(k)
        return out
    lanes = np.zeros((count, 4), np.uint8)
    for k, plane in enumerate(planes):
        lanes[:, k] = np.frombuffer(unpack(plane), np.uint8)
    return lanes.reshape(-1).view("<u4")


class Writer:
    """Appends ids to one file; memory holds less than one block beside what is given."""

    def __init__(self, uri: str, bits: bool = False):
        system, path = _open(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.bits = system.open_output_stream(path), bits
        self.out.write(MAGIC + bytes([VERSION, int(bits)]))
        self.at, self.held, self.size, self.index = 6, [], 0, []

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK:
            together = np.concatenate(self.held)
            whole = len(together) // BLOCK * BLOCK
            for low in range(0, whole, BLOCK):
                self._block(together[low : low + BLOCK])
            self.held, self.size = [together[whole:]], len(together) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = pack_block(ids, self.bits)
        self.index.append([self.at, len(ids), [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.size:
            self._block(np.concatenate(self.held))
        index = json.dumps(self.index).encode()
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()


class Reader:
    """Reads ranges of ids of one file by its chunk index; the last block read is kept."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        end = self.file.read_at(12, size - 12)
        if end[8:] != MAGIC:
            raise ValueError(f"{uri} isn't a whole file of token planes")
        length = struct.unpack("<Q", end[:8])[0]
        self.index = json.loads(self.file.read_at(length, size - 12 - length))
        self.bits = bool(self.file.read_at(6, 0)[5])
        self.before = np.concatenate([[0], np.cumsum([x[1] for x in self.index])]).astype(np.int64)
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _block(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            at, count, lengths = self.index[k]
            data, planes = self.file.read_at(sum(lengths), at), []
            for n in lengths:
                planes.append(data[:n])
                data = data[n:]
            self.kept = k, unpack_block(planes, count, self.bits)
        return self.kept[1]

    def read(self, start: int, count: int) -> np.ndarray:
        out, at, stop = [], start, start + count
        while at < stop:
            k = int(np.searchsorted(self.before, at, side="right")) - 1
            low = at - int(self.before[k])
            got = self._block(k)[low : low + stop - at]
            out.append(got)
            at += len(got)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def close(self) -> None:
        self.file.close()


def write(documents: DataFrame, vocabulary: str, end_id: int, bits: bool = False) -> str:
    """Encode and write all documents; gives the store's folder, with its catalogue in ``catalogue``."""
    spark = documents.sparkSession
    folder = shared.new_path(spark, "token-planes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.planes"
        writer, encoder, at = None, token_ids.encoder(vocabulary), 0
        for block in kernels.blocks(batches, "text"):
            ids, offsets = encoder.encode(block.column(block.schema.get_field_index("text")))
            n = block.num_rows
            counts = np.diff(offsets) + 1
            ends = np.cumsum(counts)
            with_end = np.full(int(ends[-1]), end_id, np.uint32)
            with_end[np.arange(len(ids)) + np.repeat(np.arange(n), counts - 1)] = ids
            writer = writer or Writer(uri, bits)
            writer.append(with_end)
            yield pa.record_batch({
                "doc_id": block.column(block.schema.get_field_index("doc_id")), "part": pa.array(np.full(n, part, np.int32)), "file": pa.array([uri] * n, pa.string()),
                "start": pa.array(at + ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
            })
            at += int(ends[-1])
        if writer:
            writer.close()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(ordering.partitions(documents), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(run, CATALOGUE).write.parquet(f"{folder}/catalogue")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before. The catalogue holds each file's
    documents together and in order, so a file is read from front to back.
    """
    catalogue = spark.read.schema(CATALOGUE).parquet(f"{folder}/catalogue")
    # a row for each part, of which there are as many as partitions
    sums = catalogue.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            file, start, count = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "start", "n_tokens"))
            crc = []
            for f, a, n in zip(file, start, count, strict=True):
                if f != name:
                    if reader:
                        reader.close()
                    reader, name = Reader(f), f
                crc.append(zlib.crc32(reader.read(a, n).astype("<u4", copy=False).tobytes()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "part", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "part", "start", "n_tokens", "ids_crc32"])
        if reader:
            reader.close()

    found = catalogue.mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    placed = found.join(F.broadcast(sums), F.col("part") == F.col("_part"))
    return placed.select("doc_id", (F.col("base") + F.col("start")).cast("long").alias("start"), "n_tokens", "ids_crc32")
