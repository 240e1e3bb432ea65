"""Line, paragraph or sentence deduplication over a corpus.

A unit is normalised (ASCII lower case, runs of white space as one space, none at the ends) and
named by a 128-bit digest. Of all units with one digest the earliest stays, by document id and
then by place; the others are *later occurrences* and are removed, with their byte offsets in the
original text, if they stand in a run of at least ``min_run`` words: neighbouring later occurrences
of one document, units without words not counted. With ``min_run`` 0 each goes by itself.

Lines end at line feeds, paragraphs at blank lines. Sentences end after each row of ``.!?`` (and
their full-width forms) and line feeds, so that the breaks of a passage are the same wherever it
was pasted into a line; they cover the text without gaps. Of a passage pasted between two texts
only the first and the last sentence can differ, so a run of ``MIN_RUN`` words, half of the
shortest passage of 50 words that is to be found, tells a passage from a boilerplate sentence.

Units of fewer than ``min_words`` words are never later occurrences.

Only (digest, place) rows are shuffled, with partial aggregation, so a unit in a third of all
documents is one row per map task on the way to its group; the first occurrences are a table of
their own, so that the join back to a very common unit is split by AQE.

Defined cases: null text has no units; null ids sort last; rows of one id are ordered by a digest
of their text, and equal rows of one id are the same document, so they do not remove each other's
units; no column of ``docs`` but its id and its text is read, whatever the others are called.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import runs, text_buffer
from .workspace import Workspace

MIN_WORDS = 5
MIN_RUN = 25
_LAST = 2**63 - 1
_UNIT_BITS = 40
_BREAKS = {"line": re.compile(rb"\n"), "paragraph": re.compile(rb"\n(?:[ \t\r\x0b\x0c]*\n)+"), "sentence": re.compile(rb"(?:[.!?\n]|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)+")}
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def units(raw: bytes, unit: str) -> list[tuple[int, int]]:
    """Byte spans of the units: lines and paragraphs without the breaks between them, sentences with the break after each."""
    breaks = _BREAKS[unit].finditer(raw)
    if unit == "sentence":
        ends = [m.end() for m in breaks]
        if len(raw) > (ends[-1] if ends else 0):
            ends.append(len(raw))
        return list(zip([0, *ends], ends, strict=False))
    out, at = [], 0
    for m in breaks:
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(raw)))
    return out


def _digests(unit: str, min_words: int):
    least = max(1, min_words)

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in runs(offsets):
                names, own, locs = [], [], []
                for i in range(lo, hi):
                    folded = data[int(offsets[i]) : int(offsets[i + 1])].tobytes().translate(_FOLD)
                    tag = tags[i] << _UNIT_BITS
                    before = len(names)
                    for k, (a, b) in enumerate(units(folded, unit)):
                        words = folded[a:b].split()
                        if len(words) >= least:
                            names.append(digest(b" ".join(words)))
                            locs.append(tag + k)
                    own += [ids[i]] * (len(names) - before)
                halves = np.frombuffer(b"".join(names), dtype=">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(own, pa.int64()), pa.array(locs, pa.int64())], names=["d1", "d2", "id", "loc"])

    return run


def in_long_runs(raw: bytes, spans: list[tuple[int, int]], found: set[int], min_run: int) -> set[int]:
    """Those of the found units that stand in runs of at least ``min_run`` words."""
    out: set[int] = set()
    held, size = [], 0
    for k, (a, b) in enumerate(spans):
        n = len(raw[a:b].split())
        if k in found:
            held.append(k)
            size += n
        elif n:
            if size >= min_run:
                out.update(held)
            held, size = [], 0
    if size >= min_run:
        out.update(held)
    return out


_CUT = "doc_id long, n_units long, removed array<struct<unit:int,start:long,stop:long>>, kept_text string"


def _cut(unit: str, min_run: int):
    kind = pa.list_(pa.struct([("unit", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            missing = batch.column(1).is_null().to_pylist()
            total, gone, kept = [], [], []
            for i, found in enumerate(batch.column(2).to_pylist()):
                raw = data[int(offsets[i]) : int(offsets[i + 1])].tobytes()
                spans = units(raw, unit)
                drop = in_long_runs(raw, spans, set(found), min_run) if found else set()
                total.append(0 if missing[i] else len(spans))
                gone.append([{"unit": k, "start": spans[k][0], "stop": spans[k][1]} for k in sorted(drop)])
                if not drop:
                    kept.append(None if missing[i] else raw.decode())
                    continue
                # a removed unit goes with the break after it, or with the one before if it is the last
                parts = [raw[a : spans[k + 1][0] if k + 1 < len(spans) else b] for k, (a, b) in enumerate(spans) if k not in drop]
                if parts and len(spans) - 1 in drop:
                    last = max(k for k in range(len(spans)) if k not in drop)
                    parts[-1] = raw[spans[last][0] : spans[last][1]]
                kept.append(b"".join(parts).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.string())], names=["doc_id", "n_units", "removed", "kept_text"])

    return run


def remove_repeated_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, min_run: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_units, removed (unit, start, stop in bytes), kept_text: a row for each row of ``docs``."""
    ws = Workspace(docs.sparkSession, "lines")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.pmod(F.xxhash64(text_col), F.lit(1 << 22)).alias("tag"), F.col(text_col).alias("body"))
    seen = ws.put(rows.mapInArrow(_digests(unit, min_words), "d1 long, d2 long, id long, loc long"), "units")
    place = F.struct("id", "loc")
    first = ws.put(seen.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last"), "first")
    again = seen.join(first, ["d1", "d2"]).where((F.col("id") != F.col("first.id")) | (F.col("loc") != F.col("first.loc")))
    drop = ws.put(again.groupBy("id", F.shiftright("loc", _UNIT_BITS).alias("tag")).agg(F.collect_set(F.col("loc").bitwiseAND(2**_UNIT_BITS - 1).cast("int")).alias("drop")), "removed")
    named = F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id")
    return rows.join(drop, ["id", "tag"], "left").select(named, "body", "drop").mapInArrow(_cut(unit, min_run), _CUT)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``remove_repeated_units`` for sentences in runs of at least ``MIN_RUN`` words: the registered query."""
    return remove_repeated_units(docs, "sentence", min_words=1, min_run=MIN_RUN, id_col=id_col, text_col=text_col)


def digest(result: DataFrame) -> DataFrame:
    """The registered query's columns: counts and a digest in place of the text."""
    return result.select(
        "doc_id",
        "n_units",
        F.size("removed").cast("long").alias("n_removed"),
        F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"]), F.lit(0)).alias("removed_bytes"),
        F.concat_ws(",", F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["stop"]))).alias("removed_spans"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


#: DuckDB SQL of lines of five words or more, each removed by itself. The white space is [\x20\x09-\x0D].
LINE_SQL = r"""
WITH units AS (
  SELECT doc_id, u.k AS k, u.raw AS raw,
         trim(regexp_replace(translate(u.raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: {'k': i - 1, 'raw': parts[i]})) AS u
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), ranked AS (
  SELECT doc_id, k, raw,
         coalesce(sum(octet_length(encode(raw)) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         len(string_split(norm, ' ')) >= 5 AND norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) > 1 AS gone
  FROM units
), found AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(sum(octet_length(encode(raw))) FILTER (WHERE gone), 0) AS removed_bytes,
         coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + octet_length(encode(raw)) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE gone), '') AS removed_spans,
         coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS kept
  FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(f.n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(f.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(f.removed_bytes, 0) AS BIGINT) AS removed_bytes, coalesce(f.removed_spans, '') AS removed_spans,
       sha256(coalesce(f.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN found f USING (doc_id)
"""

#: DuckDB SQL of the registered query: sentences in runs of MIN_RUN words
SQL = rf"""
WITH units AS (
  SELECT doc_id, u.k AS k, u.raw AS raw,
         trim(regexp_replace(translate(u.raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: {{'k': i - 1, 'raw': parts[i]}})) AS u
        FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n。！？]*[.!?\n。！？]+|[^.!?\n。！？]+') AS parts FROM documents WHERE text IS NOT NULL))
), placed AS (
  SELECT doc_id, k, raw, norm, len(string_split(norm, ' ')) AS n_words,
         coalesce(sum(octet_length(encode(raw))) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) > 1 AS again
  FROM units
), islands AS (
  SELECT doc_id, k, again, n_words, row_number() OVER (PARTITION BY doc_id ORDER BY k) - row_number() OVER (PARTITION BY doc_id, again ORDER BY k) AS island
  FROM placed WHERE norm <> ''
), judged AS (
  SELECT doc_id, k, again AND sum(n_words) OVER (PARTITION BY doc_id, again, island) >= {MIN_RUN} AS gone FROM islands
), ranked AS (
  SELECT p.*, coalesce(j.gone, false) AS gone FROM placed p LEFT JOIN judged j USING (doc_id, k)
), found AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(sum(octet_length(encode(raw))) FILTER (WHERE gone), 0) AS removed_bytes,
         coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + octet_length(encode(raw)) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE gone), '') AS removed_spans,
         coalesce(string_agg(raw, '' ORDER BY k) FILTER (WHERE NOT gone), '') AS kept
  FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(f.n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(f.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(f.removed_bytes, 0) AS BIGINT) AS removed_bytes, coalesce(f.removed_spans, '') AS removed_spans,
       sha256(coalesce(f.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN found f USING (doc_id)
"""
