"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under the session's ``spark.checkpoint.dir``; under ``/tmp/checkpoints`` only where that is unset and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(named or '/tmp/checkpoints').rstrip('/')}/lectern/{name}-{uuid.uuid4().hex}"


def system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = system(spark, path)
    return files.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, where = system(spark, path)
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    files, where = system(spark, path)
    files.delete(where, True)
