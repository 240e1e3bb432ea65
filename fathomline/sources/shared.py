"""Plans cut by the folder that the driver and the executors share, and small files on any Hadoop file system."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="fathomline-"))
    return _OWN[0]


def cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, kept where a lost executor does not take them along."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


#: files that one task reads with Python
READ = 1 << 10


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows dealt out for Python to work on; by their bytes alone, small rows would meet in one task."""
    return df.repartition(max(1, -(-n // READ)), *keys)


class Files:
    """Small driver-side files below a root on the file system that its URI names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.store = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.store.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.store.listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.store.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside the file and rename over it, so that a reader sees the old text or the new one."""
        beside = self.path(f".{name}.new")
        stream = self.store.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self.path(name)
        if not self.store.rename(beside, target):
            self.store.delete(target, False)
            if not self.store.rename(beside, target):
                raise OSError(f"{target.toString()} cannot be replaced")

    def delete(self, name: str = "") -> None:
        self.store.delete(self.path(name), True)
