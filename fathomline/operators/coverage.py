"""What a published index covers: listings with a cursor, histograms, and why a path is left out."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LEAST, MOST = 1, 200


def statuses(found: DataFrame, published: DataFrame, excluded: DataFrame) -> DataFrame:
    """(path, status, reason): ``indexed``, ``pending`` (new or changed), ``deleted`` (published, not there any more) or ``excluded``.

    ``found`` and ``published`` are manifests (path, sha256), ``excluded`` is (path, reason).
    """
    met = found.select("path", F.col("sha256").alias("now")).join(published.select("path", F.col("sha256").alias("then")), "path", "full").join(excluded.select("path", "reason"), "path", "full")
    status = F.when(F.col("reason").isNotNull(), "excluded").when(F.col("now").isNull(), "deleted").when(F.col("then").isNull() | (F.col("now") != F.col("then")), "pending").otherwise("indexed")
    return met.select("path", status.alias("status"), "reason")


def histogram(rows: DataFrame) -> DataFrame:
    """(status, reason, n)."""
    return rows.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def below(rows: DataFrame, path: str) -> DataFrame:
    """The rows at a path or below it; ``.`` is everything."""
    return rows if path == "." else rows.where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))


def page(rows: DataFrame, identity: str, path: str = ".", limit: int = 50, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """The next ``limit`` rows by path, and the cursor of those after them.

    A cursor is bound to the path and to the identity of what was listed; with another it is an error.
    """
    if not LEAST <= limit <= MOST:
        raise ValueError(f"limit must be from {LEAST} to {MOST}")
    rows = below(rows, path)
    if cursor is not None:
        try:
            held = json.loads(base64.urlsafe_b64decode(cursor.encode()))
            after = held["after"]
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("the cursor is malformed") from e
        if held.get("identity") != identity or held.get("path") != path:
            raise ValueError("the cursor belongs to another listing")
        rows = rows.where(F.col("path") > after)
    first = rows.orderBy("path").limit(limit + 1).collect()
    shown = rows.sparkSession.createDataFrame(first[:limit], rows.schema)
    if len(first) <= limit:
        return shown, None
    return shown, base64.urlsafe_b64encode(json.dumps({"after": first[limit - 1]["path"], "identity": identity, "path": path}).encode()).decode()


def why_excluded(path: Column, globs: tuple[str, ...] = ()) -> Column:
    """The reason to leave out a path that was asked for by name, files and folders alike; null if nothing speaks against it."""
    folder = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in T.SKIP_DIRS]))
    named = F.lit(None).cast("string")
    for glob in globs:
        named = F.coalesce(named, F.when(path.rlike(T.glob_pattern(glob)), "configured-exclusion"))
    return F.when(folder, "dependency-or-build-directory").otherwise(F.coalesce(named, T.path_exclusion(path)))
