"""Change streams: latest state of each path, debounce, generation diffs, and an index kept current."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources import store


def latest(changes: DataFrame) -> DataFrame:
    """(path, state, ts): the last change of each path; a partial aggregate, no window."""
    best = F.max(F.struct("ts", "seq", "state")).alias("x")
    return changes.groupBy("path").agg(best).select("path", "x.state", "x.ts")


def debounced(changes: DataFrame, gap: str) -> DataFrame:
    """(path, begin, stop, n): changes of a path closer than ``gap`` are one; works on batches and streams."""
    return changes.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("path", F.col("w.start").alias("begin"), F.col("w.end").alias("stop"), "n")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between manifests (path, sha256): added, changed, deleted, same."""
    met = before.select("path", F.col("sha256").alias("old")).join(after.select("path", F.col("sha256").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return met.select("path", change.alias("change"))


def watch(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of change files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def keep_current(changes: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each batch's latest states to ``publish(states, batch_id)``, which must be idempotent in the batch id; ends when all is read."""
    return changes.writeStream.foreachBatch(lambda batch, k: publish(latest(batch), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(before: DataFrame | None, states: DataFrame) -> DataFrame:
    """The states (path, state, ts) after a batch of later ones: the newest of each path."""
    rows = states if before is None else before.select(*states.columns).unionByName(states)
    return rows.groupBy("path").agg(F.max(F.struct("ts", "state")).alias("x")).select("path", "x.state", "x.ts")


def publish_states(root: str) -> Callable[[DataFrame, int], None]:
    """A ``publish`` for ``keep_current``: each batch makes a new version of the table ``states`` below ``root``; a batch that is handed over again changes nothing."""

    def publish(states: DataFrame, batch: int) -> None:
        spark = states.sparkSession
        before = None
        if store.published(spark, root):
            info, tables = store.current(spark, root)
            if info["batch"] >= batch:
                return
            before = tables["states"]
        store.publish(root, {"states": folded(before, states)}, {"batch": batch})

    return publish


def manifest_identity(manifest: DataFrame) -> str:
    """A digest of a manifest (path, sha256) in any order."""
    row = manifest.select(F.xxhash64("path", "sha256").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")).first()
    return f"{row['n']}-{(row['x'] or 0) & (2**64 - 1):016x}-{row['s'] or 0:x}"


class SourceChanged(RuntimeError):
    """The source changed while something was made of it."""


def publish_unchanged(root: str, build: Callable[[], dict[str, DataFrame]], manifest: Callable[[], DataFrame]) -> str:
    """Publish what ``build`` makes only if the manifest is the same before and after; else ``SourceChanged``, and nothing is published."""
    before = manifest_identity(manifest())
    tables = build()
    spark = next(iter(tables.values())).sparkSession
    version = store.begin(spark, root)
    for name, df in tables.items():
        store.put(df, f"{root}/{version}/{name}")
    if manifest_identity(manifest()) != before:
        store.Files(spark, root).delete(version)
        raise SourceChanged(root)
    store.finish(spark, root, version, {"identity": before})
    return version


def await_identity(spark: SparkSession, root: str, identity: str, deadline: float, poll: float = 0.2) -> dict:
    """The description once the published version has this identity; ``TimeoutError`` after ``deadline`` seconds."""
    end = time.monotonic() + deadline
    while True:
        if store.published(spark, root) and (info := store.description(spark, root)).get("identity") == identity:
            return info
        if time.monotonic() >= end:
            raise TimeoutError(f"{root} was not published as {identity} in {deadline} s")
        time.sleep(poll)


def verified_read(action: Callable[[], object], manifest: Callable[[], DataFrame]) -> tuple[object, bool]:
    """The result of an action, and whether the source was the same before and after it."""
    before = manifest_identity(manifest())
    out = action()
    return out, manifest_identity(manifest()) == before


@dataclass
class Backoff:
    """How long to wait after failures: twice as long each time for the same identity, up to ``most``."""

    poll: float = 1.0
    most: float = 60.0
    failures: dict[str, int] = field(default_factory=dict)

    def failed(self, identity: str) -> float:
        """Note a failure; only the latest identity is remembered."""
        k = self.failures.get(identity, 0)
        self.failures = {identity: k + 1}
        return min(self.most, max(2.0, self.poll) * 2.0**k)

    def succeeded(self) -> None:
        self.failures = {}


@dataclass
class Idle:
    """What an unused index does: pause its streams after ``pause`` seconds, give up its caches after ``unload``."""

    pause: float = 60.0
    unload: float = 120.0
    last: float = field(default_factory=time.monotonic)

    def used(self, now: float | None = None) -> None:
        self.last = time.monotonic() if now is None else now

    def phase(self, now: float | None = None) -> str:
        idle = (time.monotonic() if now is None else now) - self.last
        return "unloaded" if idle >= self.unload else "paused" if idle >= self.pause else "active"


def run_with_deadline(spark: SparkSession, action: Callable[[], object], seconds: float) -> object:
    """Run an action; its Spark jobs are cancelled and ``TimeoutError`` is raised when time is up."""
    import threading
    import uuid

    tag = f"deadline-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.interruptTag(tag)

    spark.addTag(tag)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"cancelled after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
