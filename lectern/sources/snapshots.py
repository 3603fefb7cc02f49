"""Tables of documents that change together: all of a change is seen, or nothing of it.

A change writes new files for each table and the ids whose earlier rows it replaces, and then one
manifest, put in place by a rename that fails if another writer was first. Readers take the last
manifest and what it names; files are never written again, so a plan that was made before a change
goes on with what it saw. A row is hidden by a later change that names its document. What a stopped
change has left is in no manifest, and ``clean`` removes it.

Defined results: rows without the key are kept by every change. A change may name documents that
are not there. Repeated rows stay repeated. Tables without rows have the schema of their first change.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import folders


class Conflict(Exception):
    """Another change was committed first; nothing of this one is seen."""


class Snapshots:
    """Tables in one folder, by name."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def version(self) -> int:
        """The number of the last change, 0 before the first."""
        files, where = folders.system(self.spark, f"{self.path}/manifests")
        if not files.exists(where):
            return 0
        return max((int(s.getPath().getName()) for s in files.listStatus(where) if s.getPath().getName().isdigit()), default=0)

    def _manifest(self, version: int) -> list[dict]:
        """The changes that make up a version: number, folders of new rows by table, folder of replaced ids."""
        if not version:
            return []
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:012d}", wholetext=True).first().value)

    def _commit(self, version: int, changes: list[dict]) -> None:
        context = self.spark._jvm.org.apache.hadoop.fs
        draft, final = context.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}"), context.Path(f"{self.path}/manifests/{version:012d}")
        files = draft.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(changes).encode()))
        stream.close()
        try:
            none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)
        except Exception as error:
            files.delete(draft, False)
            if files.exists(final):
                raise Conflict(f"version {version} of {self.path} was committed by another writer") from error
            raise

    def change(self, rows: dict[str, DataFrame], replaced: DataFrame | None = None) -> int:
        """Add rows to tables, in place of all earlier rows, in every table, of the ids in ``replaced``; gives the new version."""
        before = self.version()
        version, token = before + 1, uuid.uuid4().hex
        made = {}
        for name, frame in rows.items():
            made[name] = f"data/{name}/{token}"
            frame.withColumn("_version", F.lit(version).cast("long")).write.mode("errorifexists").parquet(f"{self.path}/{made[name]}")
        gone = None
        if replaced is not None:
            gone = f"replaced/{token}"
            replaced.select(self.key).distinct().withColumn("_upto", F.lit(version).cast("long")).write.mode("errorifexists").parquet(f"{self.path}/{gone}")
        self._commit(version, [*self._manifest(before), {"version": version, "data": made, "replaced": gone}])
        return version

    def delete(self, ids: DataFrame) -> int:
        """Remove the rows of some documents from every table."""
        return self.change({}, ids)

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables as of one version, by default the last."""
        changes = self._manifest(self.version() if version is None else version)
        return {name: self._visible(changes, name) for name in dict.fromkeys(n for c in changes for n in c["data"])}

    def _visible(self, changes: list[dict], name: str) -> DataFrame:
        rows = self.spark.read.parquet(*(f"{self.path}/{c['data'][name]}" for c in changes if name in c["data"]))
        gone = [f"{self.path}/{c['replaced']}" for c in changes if c["replaced"]]
        if gone:
            last = self.spark.read.parquet(*gone).groupBy(self.key).agg(F.max("_upto").alias("_upto"))
            rows = rows.join(last.withColumnRenamed(self.key, "_gone"), (F.col(self.key) == F.col("_gone")) & (F.col("_version") < F.col("_upto")), "left_anti")
        return rows.drop("_version")

    def compact(self) -> int:
        """The same tables as one change, so that later reads hide nothing."""
        before = self.version()
        tables, version, token = self.read(before), before + 1, uuid.uuid4().hex
        made = {}
        for name, frame in tables.items():
            made[name] = f"data/{name}/{token}"
            frame.withColumn("_version", F.lit(version).cast("long")).write.mode("errorifexists").parquet(f"{self.path}/{made[name]}")
        self._commit(version, [{"version": version, "data": made, "replaced": None}])
        return version

    def clean(self) -> None:
        """Remove files that the last version doesn't name. Not beside readers of earlier versions or other writers."""
        kept = {p for c in self._manifest(self.version()) for p in (*c["data"].values(), c["replaced"])}
        files, root = folders.system(self.spark, f"{self.path}/data")
        groups = [f"data/{s.getPath().getName()}" for s in files.listStatus(root)] if files.exists(root) else []
        for group in [*groups, "replaced"]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{group}")
            for one in files.listStatus(where) if files.exists(where) else []:
                if f"{group}/{one.getPath().getName()}" not in kept:
                    files.delete(one.getPath(), True)
