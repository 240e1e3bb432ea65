"""Gapless numbers within groups of any size, without a window over a whole group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: rows that one window partition should hold
BUCKET_ROWS = 4096


def id_digest(id_col: str) -> F.Column:
    """32 hexadecimal digits that order rows at random, the same for equal ids in any engine."""
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def numbered(rows: DataFrame, group: str, digest: str, ties: list[str], n_rows: int, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... within each ``group``, ordered by ``digest`` and then ``ties``.

    A group is cut by leading digits of the digest into buckets of about ``BUCKET_ROWS`` rows.
    ``n_rows`` is the number of rows of the largest group.
    """
    digits = max(0, math.ceil(math.log(max(1, n_rows) / BUCKET_ROWS, 16))) if n_rows > BUCKET_ROWS else 0
    return numbered_in_buckets(rows, group, F.substring(digest, 1, digits), [digest, *ties], out)


def numbered_in_buckets(rows: DataFrame, group: str, bucket: F.Column, order: list[str], out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... within each ``group``, a whole number from 0 on or null, by ``bucket`` and then ``order``.

    Each bucket is numbered by itself and moved by the counts of the buckets before it. The counts
    are one row for each bucket. They are joined by the keys that the window is dealt by, so that the
    rows, which may hold whole texts, are shuffled once. Keys that cannot be null spare the join a
    filter that works them out once more; ``bucket`` should be such a column.
    """
    key = F.coalesce(F.col(group).cast("long"), F.lit(-1).cast("long"))
    cut = rows.withColumn("_bucket", bucket).withColumn("_key", key)
    sizes = rows.select(key.alias("_group"), bucket.alias("_bucket")).groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col("_group"), F.col("_bucket").alias("_at"), F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy("_key", "_bucket").orderBy(*order)) - 1
    placed = cut.withColumn("_own", own)
    return placed.join(starts, (F.col("_key") == F.col("_group")) & (F.col("_bucket") == F.col("_at"))).withColumn(out, F.col("_start") + F.col("_own")).drop("_bucket", "_key", "_own", "_group", "_at", "_start")
