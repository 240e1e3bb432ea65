"""Intermediate tables in the folder that the driver and the executors share.

A plan that is cut this way survives the loss of an executor: what was written
is read again instead of being computed again, and no copy lives on one machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
#: Spark removes a plan's shuffle files when the plan has ended
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="fathomline-"))
    return _OWN_DIR[0]


class Workspace:
    """A folder of Parquet tables for one run of an operator.

    A result may be read for as long as the application runs; the folder is deleted when it ends,
    with or without ``spark.stop()``. Tables that no later plan reads go at once by ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._named = False

    def _path(self, path: str):
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(context._jsc.hadoopConfiguration()), target

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back without its lineage; the shuffle files of ``df`` go with the write."""
        path = f"{self.root}/{name}"
        schema = df.schema
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        if not self._named:
            store, root = self._path(self.root)
            store.deleteOnExit(root)
            self._named = True
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        for name in names:
            store, target = self._path(f"{self.root}/{name}")
            store.delete(target, True)
