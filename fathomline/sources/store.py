"""File listing, content-addressed tables and versioned publication."""

from __future__ import annotations

import json
import os
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import Files, cut

#: limits of one snapshot
MAX_FILES, MAX_TOTAL = 50_000, 256 * 1024 * 1024


def listed(root: str) -> list[str]:
    """Paths below ``root``, by git where it is a work tree, else by a walk that follows no links; sorted."""
    found = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True)
    if found.returncode == 0:
        names = {n for n in found.stdout.decode().split("\0") if n}
    else:
        names = set()
        for folder, inner, files in os.walk(root):
            inner[:] = [d for d in inner if d not in T.SKIP_DIRS and not os.path.islink(os.path.join(folder, d))]
            names |= {os.path.relpath(os.path.join(folder, f), root) for f in files}
    top = os.path.realpath(root) + os.sep
    return sorted(n for n in names if os.path.isfile(p := os.path.join(root, n)) and not os.path.islink(p) and os.path.realpath(p).startswith(top))


def snapshot(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(files, excluded): texts with their SHA-256, and (path, reason) of what is left out. Paths are judged before contents are read."""
    names = spark.createDataFrame([(n,) for n in listed(root)], "path string")
    reason = T.path_exclusion(F.col("path"))
    for glob in exclude:
        reason = F.coalesce(reason, F.when(F.col("path").rlike(T.glob_pattern(glob)), "configured"))
    judged = names.select("path", reason.alias("reason"))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{os.path.abspath(root)}")
    prefix = f"file:{os.path.abspath(root)}/"
    contents = raw.select(F.regexp_replace("path", "^file:/+", "file:/").alias("full"), "length", "content").select(F.expr(f"substring(full, {len(prefix) + 1})").alias("path"), "length", "content")
    met = judged.where("reason is null").join(contents, "path")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "^﻿", ""))
    read = met.select("path", "length", F.sha2("content", 256).alias("sha256"), text.alias("text"))
    fault = F.when(F.col("length") > T.MAX_BYTES, "file-too-large").otherwise(F.when(F.col("text").isNull(), "non-utf8").otherwise(T.eligibility(F.col("text"))))
    read = read.withColumn("reason", fault)
    files = read.where("reason is null").select("path", "text", "sha256", "length", T.language_for(F.col("path")).alias("language"))
    excluded = judged.where("reason is not null").unionByName(read.where("reason is not null").select("path", "reason"))
    return files, excluded


def admitted(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_TOTAL) -> DataFrame:
    """(files, bytes, admitted) of a snapshot."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("admitted", (F.col("files") <= max_files) & (F.col("bytes") <= max_bytes))


def put(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back without its lineage."""
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def missing(store: str, rows: DataFrame, key: str = "key") -> DataFrame:
    """The rows whose key the Parquet store lacks; the store may be on any file system, or not be there yet."""
    spark = rows.sparkSession
    if not any(n.endswith(".parquet") for n in Files(spark, store).names()):
        return rows
    return rows.join(spark.read.parquet(store).select(key), key, "left_anti")


def put_missing(store: str, rows: DataFrame, key: str = "key") -> int:
    """Append the rows whose key the Parquet store lacks; returns how many. One writer at a time."""
    new = cut(missing(store, rows.dropDuplicates([key]), key))
    n = new.count()
    if n:
        new.write.mode("append").parquet(store)
    return n


def begin(spark: SparkSession, root: str) -> str:
    """The name of a new version below ``root``."""
    return uuid.uuid4().hex


def finish(spark: SparkSession, root: str, version: str, info: dict) -> None:
    """Replace the pointer in one step; readers keep the version they opened."""
    Files(spark, root).replace("current.json", json.dumps({"version": version, **info}, sort_keys=True))


def publish(root: str, tables: dict[str, DataFrame], info: dict) -> str:
    """Write a new version beside the others, then point at it."""
    spark = next(iter(tables.values())).sparkSession
    version = begin(spark, root)
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    finish(spark, root, version, info)
    return version


def published(spark: SparkSession, root: str) -> bool:
    return Files(spark, root).exists("current.json")


def description(spark: SparkSession, root: str) -> dict:
    return json.loads(Files(spark, root).read("current.json"))


def current(spark: SparkSession, root: str, tries: int = 3) -> tuple[dict, dict[str, DataFrame]]:
    """The published version's description and tables; read again if another version is published meanwhile."""
    files = Files(spark, root)
    for _ in range(tries):
        info = description(spark, root)
        folder = f"{root}/{info['version']}"
        tables = {name: spark.read.parquet(f"{folder}/{name}") for name in files.names(info["version"])}
        if description(spark, root)["version"] == info["version"]:
            return info, tables
    raise OSError("the published version kept changing")


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all versions but the published one and the ``keep - 1`` newest others; returns their names."""
    files = Files(spark, root)
    now = description(spark, root)["version"]
    others = sorted(((s.getModificationTime(), s.getPath().getName()) for s in files.store.listStatus(files.path("")) if s.isDirectory() and s.getPath().getName() != now), reverse=True)
    gone = [name for _, name in others[max(0, keep - 1) :]]
    for name in gone:
        files.delete(name)
    return gone


#: fixed values: fields that tell whether a file can have changed
SIGNATURE = ["path", "length", "modified"]


def rehash(listing: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, to_read) of a listing (path, length, modified): files whose signature is in ``before`` keep its sha256, the others must be read."""
    known = listing.join(before.select(*SIGNATURE, "sha256"), SIGNATURE)
    return known, listing.join(before.select(*SIGNATURE), SIGNATURE, "left_anti")


def frozen_faults(frozen: DataFrame, files: DataFrame) -> DataFrame:
    """(path, fault) of inputs (path, sha256) that are ``missing`` or ``changed`` among files (path, text)."""
    met = frozen.join(files.select("path", F.sha2("text", 256).alias("now")), "path", "left")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return met.select("path", fault.alias("fault")).where("fault is not null")


def admitted_paths(manifest: DataFrame, root: str) -> DataFrame:
    """The manifest (path, sha256, ...) if no path is repeated, absolute or outside; fails otherwise."""
    copies = F.count(F.lit(1)).over(W.partitionBy("path"))
    fault = F.when(T.relative_path(F.col("path")).isNull() | (T.relative_path(F.col("path")) != F.col("path")), "a manifest path leaves the snapshot").when(copies > 1, "a manifest path is repeated").when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "a manifest digest is malformed")
    return manifest.withColumn("path", F.when(fault.isNull(), F.col("path")).otherwise(F.raise_error(fault).cast("string")))


def write_snapshot(files: DataFrame, out: str, root: str) -> None:
    """Write a manifest of files as JSON; ``out`` must lie outside ``root``."""
    norm = lambda p: os.path.normpath(p.split("://", 1)[-1])
    if (norm(out) + os.sep).startswith(norm(root) + os.sep):
        raise ValueError("the snapshot must be written outside the tree that it describes")
    files.select("path", "length", "sha256").write.mode("overwrite").json(out)


def fixtures(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of an array field of a JSON document that spans lines."""
    return spark.read.option("multiLine", True).schema(f"{field} array<struct<{schema}>>").json(path).select(F.inline(field))


def collect_garbage(store: DataFrame, manifests: list[DataFrame], key: str = "key") -> DataFrame:
    """Rows of a store that a manifest names."""
    used = manifests[0].select(key)
    for m in manifests[1:]:
        used = used.unionByName(m.select(key))
    return store.join(used.distinct(), key, "left_semi")
