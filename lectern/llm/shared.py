"""Tables that cut lineage, in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset and Spark is
local, as in tests, a folder under ``/tmp/checkpoints`` is used.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

BATCH = 2000


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or "/tmp/checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/lectern/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, computed once and read back from the shared folder."""
    return at_path(frame, name)[0]


def at_path(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_path(frame.sparkSession, name)
    with small_batches(frame.sparkSession):
        frame.write.mode("errorifexists").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH`` rows meanwhile, since a row may hold a whole set or sketch; then as before."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
