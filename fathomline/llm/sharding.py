"""Sharding by jump consistent hashing, in DataFrame expressions only.

A key walks through candidate shards 0 = b0 < b1 < ...; the next one is drawn from a linear
congruential generator seeded by the key, and the last below the number of shards is its shard.
Nothing else decides, there is no ring table, and with one more shard a row either stays or moves
into the new shard. The seed is the first 64 bits of the id's MD5, so that neighbouring ids are
independent; the 64-bit product of the generator is taken in 16-bit limbs, which cannot overflow.

The walk takes at most as many steps as there are shards, and about ln(shards) + 1 of them in the
mean; over ``MAX_STEPS`` the chance of an unfinished walk is below 1e-60 and raises an error.

Defined cases: null text has size 16 and checksum 0; null ids share one shard; equal rows are all
numbered, in any order among themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import BUCKET_ROWS, id_digest, numbered, numbered_in_buckets

MAX_STEPS = 128
_FACTOR = 2862933555777941757
_C = [(_FACTOR >> s) & 0xFFFF for s in (0, 16, 32, 48)]


def _times(hi: F.Column, lo: F.Column) -> tuple[F.Column, F.Column]:
    """(hi, lo) * factor + 1 modulo 2**64, in halves of 32 bits."""
    mask32, mask16 = F.lit(0xFFFFFFFF), F.lit(0xFFFF)
    t0, t1, t2, t3 = (lo * F.lit(c) for c in _C)
    low = t0 + F.shiftleft(t1.bitwiseAND(mask16), 16) + 1
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(t1, 16) + t2 + F.shiftleft(t3.bitwiseAND(mask16), 16) + hi * F.lit(_C[0]) + F.shiftleft((hi * F.lit(_C[1])).bitwiseAND(mask16), 16)
    return high.bitwiseAND(mask32), low.bitwiseAND(mask32)


def jump(digest: F.Column, shards: int) -> tuple[F.Column, F.Column]:
    """The shard among ``shards``, and among one more."""
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    start = F.struct(half(1).alias("h"), half(9).alias("l"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s, _):
        h, l = _times(s["h"], s["l"])
        far = ((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(h, 1) + 1).cast("double"))).cast("long")
        return F.when(s["j"] < shards, F.struct(h.alias("h"), l.alias("l"), s["j"].alias("b"), far.alias("j"))).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MAX_STEPS))), start, step)
    shard = F.when(end["j"] >= shards, end["b"]).otherwise(F.raise_error(F.lit("jump hash did not end")).cast("long"))
    return shard.cast("int"), F.when(end["j"] == shards, F.lit(shards)).otherwise(end["b"]).cast("int")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row for each row of ``docs``."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), id_digest(id_col).alias("_digest"))
    now, grown = jump(F.col("_digest"), shards)
    rows = rows.withColumn("shard", now).withColumn("grown_shard", grown)
    n = docs.count()
    # three times the even share: a shard that holds more has larger buckets, never a wrong number
    out = numbered(rows, "shard", "_digest", ["size", "text_crc32"], -(-3 * n // shards), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def sharded(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", position_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with their columns and those of ``shard``; a column of ``docs`` that has such a name gives way.

    With ``position_col``, which numbers all rows 0, 1, 2 ..., the slots of a shard follow it and
    the column itself goes; else they follow a digest of the id.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    now, grown = jump(F.col("_digest"), shards)
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    own = {f"c{k}": c for k, c in enumerate(docs.columns) if c not in added and c != position_col}
    place = [] if position_col is None else [F.col(position_col).cast("long").alias("_position")]
    rows = docs.select(*[F.col(c).alias(k) for k, c in own.items()], (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), id_digest(id_col).alias("_digest"), *place)
    rows = rows.withColumn("shard", now).withColumn("grown_shard", grown)
    if position_col is None:
        out = numbered(rows, "shard", "_digest", ["size", "text_crc32"], -(-3 * docs.count() // shards), "slot")
    else:
        out = numbered_in_buckets(rows, "shard", F.coalesce(F.floor(F.col("_position") / (BUCKET_ROWS * shards)), F.lit(0)), ["_position"], "slot")
    return out.withColumn("law", F.lit("key")).withColumn("slot", F.col("slot").cast("long")).select(*[F.col(k).alias(c) for k, c in own.items()], *added)


def _crc_sql() -> str:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(encode(body)) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def sql(shards: int) -> str:
    """DuckDB SQL of ``shard``; the checksum is taken byte by byte."""
    return f"""
WITH RECURSIVE bodies AS (
  SELECT doc_id, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), walk AS (
  SELECT digest, CAST(('0x' || substr(digest, 1, 16))::UBIGINT AS UHUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM (SELECT DISTINCT digest FROM bodies)
  UNION ALL
  SELECT digest, n AS k, j AS b, CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / CAST(n // 8589934592::UHUGEINT + 1 AS DOUBLE))) AS BIGINT) AS j
  FROM (SELECT *, (k * {_FACTOR}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS n FROM walk WHERE j < {shards})
), ended AS (
  SELECT digest, CAST(b AS INTEGER) AS shard, CASE WHEN j = {shards} THEN {shards} ELSE CAST(b AS INTEGER) END AS grown_shard FROM walk WHERE j >= {shards}
), summed AS (
  SELECT doc_id, digest, CAST(octet_length(encode(body)) + 16 AS BIGINT) AS size, CAST({_crc_sql()} AS BIGINT) AS text_crc32 FROM bodies
)
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, e.shard, row_number() OVER (PARTITION BY e.shard ORDER BY e.digest, d.size, d.text_crc32) - 1 AS slot, e.grown_shard
FROM summed d JOIN ended e USING (digest)
"""
