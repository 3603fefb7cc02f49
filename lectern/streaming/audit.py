"""Streams: a bounded audit log, resumable extraction, and counts in event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import conversation, extraction
from lectern.sources import folders

KEEP, SLACK = 5000, 250
#: Bytes of files that a batch of extraction brings: a batch of each file would be a task of each state for each file.
BATCH_BYTES = 64 << 20


def table_stream(spark: SparkSession, path: str, per_batch: int = 1, batch_bytes: int | None = None) -> DataFrame:
    """The rows of a Parquet table, a folder or one file, as its files arrive. An error if there is none.

    A batch brings ``per_batch`` files, or files of ``batch_bytes`` together; then ``arrived`` tells their order.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", per_batch) if batch_bytes is None else reader.option("maxBytesPerTrigger", batch_bytes)
    if folders.is_folder(spark, path):
        rows = reader.parquet(path)
    else:
        folder, _, name = path.rpartition("/")
        rows = reader.option("pathGlobFilter", name).parquet(folder)
    if batch_bytes is not None:
        rows = rows.withColumn("arrived", F.concat(F.lpad(F.unix_micros("_metadata.file_modification_time").cast("string"), 20, "0"), F.lit(" "), "_metadata.file_path"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def latest_version(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table that the last finished batch has written; before the first one an empty table of the schema."""
    files, root = folders.system(spark, path)
    done = [s.getPath().getName() for s in files.listStatus(root) if folders.exists(spark, f"{path}/{s.getPath().getName()}/_SUCCESS")] if files.exists(root) else []
    if done:
        return spark.read.parquet(f"{path}/{max(done)}")
    if schema is None:
        raise ValueError(f"{path} has no version yet")
    return spark.createDataFrame([], schema)


def bounded_log(events: DataFrame, path: str, keep: int = KEEP, slack: int = SLACK) -> StreamingQuery:
    """Appends events to a log that holds the newest ``keep``, cut back once ``slack`` more are there.

    Each batch writes a version of its own, so a repeated batch overwrites itself and readers see
    whole versions only.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, before = batch.sparkSession, f"{path}/log/v{number - 1:012d}"
        rows = spark.read.parquet(before).unionByName(batch) if folders.exists(spark, before) else batch
        full = conversation.newest(rows, keep, F.col("ts")) if rows.count() > keep + slack else rows
        full.write.mode("overwrite").parquet(f"{path}/log/v{number:012d}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def extracted(chunks: DataFrame, path: str, extract: Callable[[str, int], str | None], model: str) -> StreamingQuery:
    """Writes markers and records of chunks as they arrive to ``path/records``, once each, whatever restarts there are.

    What was read is keyed state of the query, so a batch costs what it brings; ``extraction.current``
    gives the last rows of each chunk.
    """
    rows = extraction.scanned_stream(chunks, extract, model)
    return rows.writeStream.format("parquet").option("path", f"{path}/records").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events by kind in windows of event time; those later than ``late`` are left out once a window is closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")


def changes(counts: DataFrame, path: str) -> StreamingQuery:
    """Writes the rows that each batch changes to a folder of that batch; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def settled(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The last value of each key that ``changes`` has written."""
    return spark.read.option("basePath", f"{path}/changes").parquet(f"{path}/changes").groupBy(*keys).agg(F.max_by(value, "batch").alias(value))
