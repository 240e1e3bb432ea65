"""Cross-entropy difference of two matched n-gram models.

Both models are bigram models over one vocabulary, all words of the corpus and the end of a text,
with additive smoothing. The background model counts every document, the target model the labelled
good ones; the background's counts are scaled by the ratio of the models' tokens, so that both have
seen equally much:

    P(w | v) = (r c(v, w) + A) / (r c(v) + A V)      r = 1 for the target

A document is scored without its own counts in either model. Its losses are the mean negative log
probabilities of its words and its end; ``score`` is target loss minus background loss, and low
scores are close to the target.

1. Documents are dealt into *runs* of about ``RUN_BYTES`` by a hash of the row, one run to a task. A run counts its
   distinct features (bigrams and contexts) and sends them, sorted and packed, to buckets by the
   leading bits of the feature's hash, so a frequent feature is one entry for each run.
2. A bucket adds up the counts of its features and answers each run in the order it asked; the
   answers are packed counts. Corpus totals are sums over the buckets.
3. A run is read again beside its answers, which line up with its sorted features, and scored.

Runs and buckets grow in number with the corpus and not in size; nothing of it is broadcast or
collected but three totals. The tasks that write files, those of 2 and 3, work through ``EACH``
buckets or runs one by one, for fewer files. The ids of good labels are sent to all tasks only up
to ``SENT_LABELS``; beyond that they are joined.

Words are ``[^\\x20\\x09-\\x0D]+`` in ASCII lower case. Defined cases: texts without words have no
losses and no score; rows of one id are documents of their own, all of them target documents if
the id is; a label counts as good only if all labels of its id are 1; null ids have no label;
without target documents all target probabilities are 1 / V.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, mix, runs, text_buffer
from .workspace import Workspace

SMOOTHING = 0.1
RUN_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: buckets or runs of a task that writes; Hadoop's local file system starts processes for each new file
EACH = 4
SENT_LABELS = 1 << 22
#: width of a feature's hash; the last bit tells contexts from bigrams
FEATURE_BITS = 56

_BEGIN, _END = np.uint64(0x51A9C3E7D2B40F6B), np.uint64(0x3C6EF372FE94F82A)
_PAIR, _CONTEXT = np.uint64(0x9FB21C651E98DF25), np.uint64(0x7F4A7C159E3779B9)


def features(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and documents: each word and end given its context, then each context.

    ``hashes`` are the words of documents that have ``n`` words each.
    """
    real = np.flatnonzero(n > 0)
    # every document with words gets one more place: its begin as a context, its end as a word
    owner = np.repeat(real.astype(np.int32), n[real] + 1)
    heads = np.cumsum(n[real] + 1) - (n[real] + 1)
    context = np.empty(len(owner), dtype=np.uint64)
    word = np.empty(len(owner), dtype=np.uint64)
    inner = np.ones(len(owner), dtype=bool)
    inner[heads] = False
    context[inner] = hashes
    context[heads] = _BEGIN
    last = np.zeros(len(owner), dtype=bool)
    last[heads + n[real]] = True
    word[~last] = hashes
    word[last] = _END
    cut = np.uint64(64 - FEATURE_BITS)
    pair = (mix(context * _PAIR + word) >> cut) & ~np.uint64(1)
    single = (mix(context ^ _CONTEXT) >> cut) | np.uint64(1)
    return np.concatenate([pair, single]), np.concatenate([owner, owner])


def packed(x: np.ndarray) -> bytes:
    """The number of bytes that the largest value needs, then that many byte planes from the lowest on."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize)[:, :width].T).tobytes()


def unpack(raw: bytes, kind: type) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(kind).reshape(-1)


class _Run:
    """The documents of one run, gathered from Arrow batches."""

    def __init__(self):
        self.texts: list[pa.Array] = []
        self.good: list[np.ndarray] = []
        self.keys: list[pa.Array] = []

    def add(self, text: pa.Array, good: pa.Array, key: pa.Array) -> None:
        self.texts.append(text)
        self.good.append(good.to_numpy(zero_copy_only=False).astype(bool))
        self.keys.append(key)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, number of words and label of each document; a stretch of text at a time is taken apart."""
        hashes, n = [], []
        for text in self.texts:
            data, offsets = text_buffer(text)
            for lo, hi in runs(offsets):
                words = Words(data, offsets, lo, hi, fold=True)
                hashes.append(words.hashes)
                n.append(np.diff(words.first))
        return np.concatenate(hashes), np.concatenate(n), np.concatenate(self.good)


_ASKED = pa.schema([("bucket", pa.int64()), ("run", pa.int64()), ("features", pa.binary()), ("background", pa.binary()), ("target", pa.binary())])


def _asked(run: int, held: _Run, bits: int) -> pa.RecordBatch:
    hashes, n, good = held.words()
    found, owner = features(hashes, n)
    names, inverse = np.unique(found, return_inverse=True)
    del found
    background = np.bincount(inverse, minlength=len(names)).astype(np.uint32)
    target = np.bincount(inverse[good[owner]], minlength=len(names)).astype(np.uint32)
    bucket = (names >> np.uint64(FEATURE_BITS - bits)).astype(np.int64) if bits else np.zeros(len(names), dtype=np.int64)
    cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(names)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    # steps from the least feature that the bucket can have
    base = lambda a: np.uint64(int(bucket[a]) << (FEATURE_BITS - bits))
    steps = [packed(np.diff(names[a:b], prepend=base(a))) for a, b in spans]
    columns = [pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array([run] * len(spans), pa.int64()), pa.array(steps, pa.binary()), *(pa.array([packed(x[a:b]) for a, b in spans], pa.binary()) for x in (background, target))]
    return pa.RecordBatch.from_arrays(columns, schema=_ASKED)


def _pieces(batch: pa.RecordBatch, column: int):
    """Ranges of rows that share a value of a sorted column."""
    values = batch.column(column).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(values[a]), batch.slice(a, b - a)


def _asking(bits: int):
    def run(batches):
        now, held = None, _Run()
        for batch in batches:
            for name, part in _pieces(batch, 0):
                if name != now:
                    if now is not None:
                        yield _asked(now, held, bits)
                    now, held = name, _Run()
                held.add(part.column(1), part.column(2), part.column(3))
        if now is not None:
            yield _asked(now, held, bits)

    return run


_ANSWERED = pa.schema([("run", pa.int64()), ("bucket", pa.int64()), ("background", pa.binary()), ("target", pa.binary()), ("contexts", pa.int64()), ("n_background", pa.int64()), ("n_target", pa.int64())])


def _answers(bucket: int, rows: list[tuple[int, bytes, bytes, bytes]]):
    # features without the bucket's base, which all of them share
    names = [np.cumsum(unpack(r[1], np.uint64), dtype=np.uint64) for r in rows]
    known, inverse = np.unique(np.concatenate(names), return_inverse=True)
    totals = []
    for column in (2, 3):
        counts = np.concatenate([unpack(r[column], np.uint32) for r in rows])
        totals.append(np.bincount(inverse, weights=counts, minlength=len(known)).astype(np.uint64))
    context = (known & np.uint64(1)).astype(bool)
    # every place of the corpus has one context, so their counts add up to its tokens
    sums = (int(context.sum()), int(totals[0][context].sum()), int(totals[1][context].sum()))
    at = 0
    for k, (run, *_) in enumerate(rows):
        own = inverse[at : at + len(names[k])]
        at += len(own)
        row = [run, bucket, packed(totals[0][own]), packed(totals[1][own]), *(sums if k == 0 else (0, 0, 0))]
        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _ANSWERED, strict=True)], schema=_ANSWERED)


def _answering(batches):
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now:
                if held:
                    yield from _answers(now, held)
                now, held = row[0], []
            held.append(row[1:])
    if held:
        yield from _answers(now, held)


_LOSSES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64())])


def _losses(held: _Run, answers: list[tuple[bytes, bytes]], vocabulary: int, ratio: float) -> pa.RecordBatch:
    hashes, n, good = held.words()
    keys = pa.concat_arrays(held.keys)
    found, owner = features(hashes, n)
    names, inverse = np.unique(found, return_inverse=True)
    del found
    counts = [np.concatenate([unpack(a[k], np.uint64) for a in answers]).astype(np.float64) if answers else np.zeros(0) for k in (0, 1)]
    if len(counts[0]) != len(names):
        raise ValueError(f"{len(counts[0])} answers for {len(names)} features")
    # how often each document has each of its features
    inverse += owner * np.int64(len(names))
    del owner
    inverse.sort()
    heads = np.flatnonzero(np.diff(inverse, prepend=-1))
    own = np.diff(heads, append=len(inverse)).astype(np.int32)
    each = inverse[heads]
    del inverse, heads
    doc, name = (each // max(1, len(names))).astype(np.int32), (each % max(1, len(names))).astype(np.int32)
    del each
    context = (names[name] & np.uint64(1)).astype(bool)
    out = []
    for count, scale, mine in ((counts[1], 1.0, own * good[doc]), (counts[0], ratio, own)):
        left = count[name] - mine
        logs = np.log(scale * left + np.where(context, SMOOTHING * vocabulary, SMOOTHING))
        out.append(np.bincount(doc, weights=own * np.where(context, logs, -logs), minlength=len(n)))
    tokens = np.where(n > 0, n + 1, 0)
    empty = tokens == 0
    return pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(np.where(empty, 0, n), pa.int64()), *(pa.array(x / np.maximum(1, tokens), pa.float64(), mask=empty) for x in out)], schema=_LOSSES)


def _scoring(vocabulary: int, ratio: float):
    def run(batches):
        now, held, answers = None, _Run(), []
        for batch in batches:
            for name, part in _pieces(batch, 0):
                if name != now:
                    if held.texts:
                        yield _losses(held, answers, vocabulary, ratio)
                    now, held, answers = name, _Run(), []
                # answers come first, in the order of their buckets
                asked = part.column(4).is_valid()
                replies = part.filter(asked)
                answers += zip(replies.column(5).to_pylist(), replies.column(6).to_pylist(), strict=True)
                texts = part.filter(part.column(4).is_null())
                if texts.num_rows:
                    held.add(texts.column(1), texts.column(2), texts.column(3))
        if held.texts:
            yield _losses(held, answers, vocabulary, ratio)

    return run


def _marker(sent):
    def run(batches):
        ids = sent.value
        for batch in batches:
            own = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(ids, own)
            at[at == len(ids)] = 0
            hit = (ids[at] == own) if len(ids) else np.zeros(len(own), dtype=bool)
            good = hit & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good)], names=["id", "body", "good"])

    return run


def marked(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, body) with whether the id is labelled good."""
    good = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("q")).where("id is not null and q is not null").groupBy("id").agg(F.min("q").alias("q")).where("q = 1").select("id")
    n = good.count()
    if n > SENT_LABELS:
        return rows.join(good.withColumn("good", F.lit(True)), "id", "left").select("id", "body", F.coalesce("good", F.lit(False)).alias("good"))
    ids = np.sort(good.toArrow().column(0).to_numpy()) if n else np.zeros(0, dtype=np.int64)
    return rows.mapInArrow(_marker(rows.sparkSession.sparkContext.broadcast(ids)), "id long, body string, good boolean")


def _answered(dealt: DataFrame, n_runs: int, bits: int, ws: Workspace) -> DataFrame:
    asked = dealt.repartitionById(n_runs, "run").mapInArrow(_asking(bits), "bucket long, run long, features binary, background binary, target binary")
    tasks = -(-(1 << bits) // EACH)
    answered = asked.repartitionById(tasks, (F.col("bucket") % tasks).cast("int")).sortWithinPartitions("bucket", "run").mapInArrow(_answering, "run long, bucket long, background binary, target binary, contexts long, n_background long, n_target long")
    return ws.put(answered, "answers")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score: one row for each row of ``docs``."""
    ws = Workspace(docs.sparkSession, "perplexity")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    n_runs, bits = max(1, math.ceil(size / RUN_BYTES)), max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    dealt = marked(rows, labels, id_col, label_col).select(F.pmod(F.xxhash64("id", "body"), F.lit(n_runs)).cast("int").alias("run"), "body", "good", "id")
    answers = _answered(dealt, n_runs, bits, ws)
    totals = answers.agg(*(F.sum(c).alias(c) for c in ("contexts", "n_background", "n_target"))).first()
    vocabulary, ratio = max(1, totals["contexts"] or 0), (totals["n_target"] or 0) / max(1, totals["n_background"] or 0)
    replies = answers.select(F.col("run").cast("int").alias("run"), F.lit(None).cast("string").alias("body"), F.lit(False).alias("good"), F.lit(None).cast("long").alias("id"), "bucket", "background", "target")
    texts = dealt.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("bucket", "long"), ("background", "binary"), ("target", "binary"))))
    tasks = -(-n_runs // EACH)
    met = replies.unionByName(texts).repartitionById(tasks, (F.col("run") % tasks).cast("int")).sortWithinPartitions("run", F.col("bucket").asc_nulls_last())
    losses = met.mapInArrow(_scoring(vocabulary, ratio), "doc_id long, n_tokens long, target_loss double, background_loss double")
    return losses.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def digest(result: DataFrame) -> DataFrame:
    """The registered query's columns: losses to six places."""
    return result.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


#: DuckDB SQL of the registered query
SQL = rf"""
WITH good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, doc_id IN (SELECT doc_id FROM good) AS good,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), places AS (
  SELECT r, good, unnest(list_concat([''], w)) AS v, unnest(list_concat(w, [''])) AS w FROM docs WHERE len(w) > 0
), own_pair AS (SELECT r, good, v, w, count(*) AS n FROM places GROUP BY ALL
), own_context AS (SELECT r, good, v, count(*) AS n FROM places GROUP BY ALL
), pair AS (SELECT v, w, sum(n) AS cb, coalesce(sum(n) FILTER (WHERE good), 0) AS ct FROM own_pair GROUP BY v, w
), context AS (SELECT v, sum(n) AS cb, coalesce(sum(n) FILTER (WHERE good), 0) AS ct FROM own_context GROUP BY v
), total AS (SELECT count(*) AS vocabulary, sum(ct)::DOUBLE / sum(cb) AS ratio FROM context
), terms AS (
  SELECT r, -n * ln(ct - CASE WHEN good THEN n ELSE 0 END + {SMOOTHING}) AS t, -n * ln(ratio * (cb - n) + {SMOOTHING}) AS b
  FROM own_pair JOIN pair USING (v, w), total
  UNION ALL
  SELECT r, n * ln(ct - CASE WHEN good THEN n ELSE 0 END + {SMOOTHING} * vocabulary) AS t, n * ln(ratio * (cb - n) + {SMOOTHING} * vocabulary) AS b
  FROM own_context JOIN context USING (v), total
), losses AS (SELECT r, sum(t) AS t, sum(b) AS b FROM terms GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(t / (len(w) + 1), 6) AS target_loss, round(b / (len(w) + 1), 6) AS background_loss,
       round(t / (len(w) + 1) - b / (len(w) + 1), 6) AS score
FROM docs LEFT JOIN losses USING (r)
"""
