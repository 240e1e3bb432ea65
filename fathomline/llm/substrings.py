"""Exact substring deduplication with a distributed enhanced suffix array.

A byte is removed when a 100-byte string that covers it also starts earlier, at a smaller
document id or earlier in the same document. Matches never cross documents.

1. Every 100-byte window is named by its *anchor*, the leftmost least hash among its 32-byte
   grams, so equal windows have equal anchors. Consecutive windows with one anchor position form
   a *piece* (about 35 windows). Anchors that occur once in the corpus cannot lie in a repeat;
   what remains is small and is all that is shuffled with positions.
2. Pieces of equal anchor and content collapse to a class. All occurrences of a class but the
   first are repeats, without looking at their text.
3. Anchors with several classes need their text: one piece per class is fetched and dealt out by
   anchor. There a suffix array over all windows of a bucket, its longest common prefixes and a
   stack scan yield the tree of common-prefix intervals; an interval whose suffixes are preceded
   by different bytes is a maximal repeat group, with all its occurrences. Windows whose classes
   share one left byte are part of a longer group and are dropped before sorting.
4. An anchor with over ``BUCKET_CLASSES`` classes would make a task grow with the corpus. Its
   windows are compared by 128-bit digests with a partial aggregate instead, which is exact too.

Defined cases: null text has no bytes; null ids sort last; rows of one id are ordered by a digest
of their text, and equal rows of one id are the same document. Other columns of the documents are
not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import _BYTE, mix, runs, text_buffer
from .workspace import Workspace

LENGTH = 100
GRAM = 32
BUCKET_CLASSES = 4096
SORT_BYTES = 4 << 20
_LAST = 2**63 - 1
_POS_BITS = 40

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _doubled(buf: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4 ... ``upto`` bytes from each position on."""
    h = _BYTE[buf]
    out, n, k = {1: h}, 1, 0
    while n < upto:
        h = h[:-n] * _M[k] + h[n:] if len(h) > n else h[:0]
        n, k = 2 * n, k + 1
        out[n] = h
    return out


def pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and document of each piece."""
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < LENGTH:
        return none.view(np.uint64), none, none, none
    grams = mix(_doubled(buf, GRAM)[GRAM])
    span = LENGTH - GRAM + 1
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    n = 1
    while 2 * n <= span:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if span > n:
        least = np.minimum(least[: len(least) - (span - n)], least[span - n :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    valid = np.zeros(len(at) + 1, dtype=np.int32)
    long = size >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    heads = offsets[:-1][long]
    new[heads] = True
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.append(new | ~valid, True))
    count = stop[np.searchsorted(stop, first, side="right")] - first
    doc = np.searchsorted(offsets, first, side="right") - 1
    return grams[at[first]], first, count, doc


def _anchor_names(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column(0))
        for lo, hi in runs(offsets):
            base = int(offsets[lo])
            m, _, _, _ = pieces(data[base : int(offsets[hi])], offsets[lo : hi + 1] - base)
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64))], names=["m"])


_PIECE = "m long, c long, id long, loc long, n int"


def _anchor_rows(batches):
    for batch in batches:
        ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        data, offsets = text_buffer(batch.column(2))
        for lo, hi in runs(offsets):
            base = int(offsets[lo])
            buf, off = data[base : int(offsets[hi])], offsets[lo : hi + 1] - base
            m, first, count, doc = pieces(buf, off)
            raw, digest = buf.tobytes(), xxhash.xxh3_64_intdigest
            c = np.fromiter((digest(raw[a : a + k + LENGTH - 1]) for a, k in zip(first.tolist(), count.tolist(), strict=True)), dtype=np.uint64, count=len(first))
            loc = (tags[lo:hi][doc] << _POS_BITS) + first - off[doc]
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(c.view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array(loc), pa.array(count.astype(np.int32))], names=["m", "c", "id", "loc", "n"])


_TEXTS = pa.schema([("m", pa.int64()), ("id", pa.int64()), ("loc", pa.int64()), ("body", pa.binary())])


def _piece_texts(batches):
    """The text of the pieces asked for; of hot anchors, each window by itself (m null, a digest as body)."""
    for batch in batches:
        ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        data, offsets = text_buffer(batch.column(2))
        out, size = ([], [], [], []), 0
        for i, asked in enumerate(batch.column(3)):
            raw, base = data[int(offsets[i]) : int(offsets[i + 1])].tobytes(), tags[i] << _POS_BITS
            for want in asked.as_py():
                p, n = want["pos"], want["n"]
                if want["hot"]:
                    found = [(None, base + s, xxhash.xxh3_128_digest(raw[s : s + LENGTH])) for s in range(p, p + n)]
                else:
                    found = [(want["m"], base + p, raw[p : p + n + LENGTH - 1])]
                for m, loc, body in found:
                    for column, x in zip(out, (m, ids[i], loc, body), strict=True):
                        column.append(x)
                    size += len(body) + 24
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, _TEXTS, strict=True)], schema=_TEXTS)
                out, size = ([], [], [], []), 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, _TEXTS, strict=True)], schema=_TEXTS)


def maximal_repeats(texts: list[bytes], order: list[tuple[int, int]], grouped: bool = True) -> tuple[list[tuple[int, list[tuple[int, int]]]], list[tuple[int, int, int]]]:
    """Maximal repeat groups of at least LENGTH bytes among texts, and what they make removable.

    Groups are (length, [(text, start), ...]) with all occurrences, made only if ``grouped``. Removable are (text, start,
    length): the longest string from there that also starts earlier by ``order`` plus the start.
    """
    sizes = np.array([len(t) for t in texts])
    stop = np.cumsum(sizes)
    begin = stop - sizes
    raw = b"".join(texts)
    buf = np.frombuffer(raw, dtype=np.uint8)
    if len(buf) < LENGTH:
        return [], []
    d = _doubled(buf, 64)
    m = len(buf) - LENGTH + 1
    window = mix(d[64][:m] * _M[5] + d[32][64 : 64 + m] * _M[6] + d[4][96 : 96 + m])
    owner = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - LENGTH + 1))
    at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(0, sizes - LENGTH + 1)) - np.maximum(0, sizes - LENGTH + 1), np.maximum(0, sizes - LENGTH + 1)) + begin[owner]
    by = np.argsort(window[at], kind="stable")
    at, owner = at[by], owner[by]
    if not len(at):
        return [], []
    w = window[at]
    head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    count = np.diff(np.append(head, len(w)))
    # left-extension diversity of each class of windows: 256 stands for the start of a text
    left = np.where(at > begin[owner], buf[np.maximum(at - 1, 0)].astype(np.int32), 256)
    lowest, highest = np.minimum.reduceat(left, head), np.maximum.reduceat(left, head)
    keep = np.repeat((count > 1) & ((lowest != highest) | (highest == 256)), count)
    at, owner = at[keep], owner[keep]
    if not len(at):
        return [], []
    ends = stop[owner].tolist()
    starts = at.tolist()
    sa = sorted(range(len(starts)), key=lambda i: raw[starts[i] : ends[i]])
    starts, ends, owners = [starts[i] for i in sa], [ends[i] for i in sa], owner[sa].tolist()
    lcp = [0] * (len(sa) + 1)
    for i in range(1, len(sa)):
        a, b = starts[i - 1], starts[i]
        top = min(ends[i - 1] - a, ends[i] - b)
        x, y = raw[a : a + top], raw[b : b + top]
        if x == y:
            lcp[i] = top
        elif x[:LENGTH] == y[:LENGTH]:
            lcp[i] = int(np.argmax(buf[a : a + top] != buf[b : b + top]))
    firsts = begin.tolist()
    place = [(order[f][0], order[f][1] + p - firsts[f]) for f, p in zip(owners, starts, strict=True)]
    before = [raw[p - 1] if p > firsts[f] else -1 - i for i, (f, p) in enumerate(zip(owners, starts, strict=True))]
    groups, gone = [], []
    # open intervals: common prefix, left bound, earliest suffix, left byte (None if they differ)
    stack: list[list] = [[0, 0, None, None]]

    def add(top: list, early: int, byte: int | None) -> None:
        if place[early] != place[top[2]]:
            lost, top[2] = (early, top[2]) if place[early] > place[top[2]] else (top[2], early)
            gone.append((owners[lost], starts[lost] - firsts[owners[lost]], top[0]))
        if byte != top[3]:
            top[3] = None

    for i in range(1, len(sa) + 1):
        length = lcp[i]
        bound, early, byte = i - 1, i - 1, before[i - 1]
        while stack[-1][0] > length:
            top = stack.pop()
            add(top, early, byte)
            _, bound, early, byte = top
            if grouped and byte is None:
                groups.append((top[0], [(owners[j], starts[j] - firsts[owners[j]]) for j in range(bound, i)]))
        if stack[-1][0] < length:
            stack.append([length, bound, early, byte])
        elif length:
            add(stack[-1], early, byte)
    return groups, gone


_RANGES = pa.schema([("id", pa.int64()), ("loc", pa.int64()), ("size", pa.int64())])


def _scan_buckets(batches):
    """Stream pieces sorted by anchor; whole buckets are sorted together, a few MB at a time."""
    texts, order, size, last = [], [], 0, None

    def flush():
        _, gone = maximal_repeats(texts, order, grouped=False)
        rows = [(order[f][0], order[f][1] + s, n) for f, s, n in gone]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], schema=_RANGES)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for m, doc, loc, body in zip(*columns, strict=True):
            if m != last and size > SORT_BYTES:
                yield flush()
                texts, order, size = [], [], 0
            last = m
            texts.append(body)
            order.append((doc, loc))
            size += len(body)
    if texts:
        yield flush()


_KEPT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def _cut(batches):
    """Maximal removed runs of each text and the bytes outside them, a few MB at a time."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        ids = batch.column(0).to_pylist()
        out, size = [], 0
        for i, found in enumerate(batch.column(2)):
            raw = data[int(offsets[i]) : int(offsets[i + 1])].tobytes()
            spans: list[list[int]] = []
            for start, stop in sorted((r["at"], r["at"] + r["size"]) for r in found.as_py() or []):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop)
                else:
                    spans.append([start, stop])
            kept = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True)) if spans else raw
            out.append({"id": ids[i], "n_bytes": len(raw), "spans": [{"start": a, "stop": b} for a, b in spans], "kept": kept})
            size += len(kept)
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=_KEPT)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_KEPT)


def removable_ranges(rows: DataFrame, ws: Workspace) -> DataFrame:
    """(id, loc, size) of repeats in rows (id, tag, body); loc is ``tag << 40`` plus the byte offset."""
    shared = rows.select("body").mapInArrow(_anchor_names, "m long").groupBy("m").count().where("count > 1").select("m")
    seen = ws.put(rows.mapInArrow(_anchor_rows, _PIECE).join(shared, "m"), "pieces")
    classes = ws.put(seen.groupBy("m", "c", "n").agg(F.min(F.struct("id", "loc")).alias("first")), "classes")
    later = seen.join(classes, ["m", "c", "n"]).where((F.col("id") != F.col("first.id")) | (F.col("loc") != F.col("first.loc"))).select("id", "loc", (F.col("n") + LENGTH - 1).cast("long").alias("size"))
    crowd = classes.groupBy("m").count().where("count > 1").select("m", (F.col("count") > BUCKET_CLASSES).alias("hot"))
    asked = (
        classes.join(crowd, "m")
        .select("m", "n", "hot", F.col("first.id").alias("id"), F.shiftright("first.loc", _POS_BITS).alias("tag"), F.col("first.loc").bitwiseAND(2**_POS_BITS - 1).alias("pos"))
        .groupBy("id", "tag")
        .agg(F.collect_list(F.struct("m", "pos", "n", "hot")).alias("asked"))
    )
    texts = ws.put(rows.join(asked, ["id", "tag"]).select("id", "tag", "body", "asked").mapInArrow(_piece_texts, "m long, id long, loc long, body binary"), "texts")
    tree = texts.where("m is not null").repartition("m").sortWithinPartitions("m").mapInArrow(_scan_buckets, "id long, loc long, size long")
    windows = texts.where("m is null").select("body", "id", "loc")
    earliest = windows.groupBy("body").agg(F.min(F.struct("id", "loc")).alias("first"), F.max(F.struct("id", "loc")).alias("last")).where("first <> last").drop("last")
    crowded = windows.join(earliest, "body").where((F.col("id") != F.col("first.id")) | (F.col("loc") != F.col("first.loc"))).select("id", "loc", F.lit(LENGTH).cast("long").alias("size"))
    return later.unionByName(tree).unionByName(crowded)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans, kept: one row for each row of ``docs``.

    ``spans`` are the maximal removed runs as byte offsets (start, stop) of the original text, in order;
    ``kept`` is what is left, as bytes, because a run may end within a character.
    """
    ws = Workspace(docs.sparkSession, "substrings")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.pmod(F.xxhash64(text_col), F.lit(1 << 22)).alias("tag"), F.col(text_col).alias("body"))
    found = removable_ranges(rows, ws)
    located = found.select("id", F.shiftright("loc", _POS_BITS).alias("tag"), F.struct(F.col("loc").bitwiseAND(2**_POS_BITS - 1).alias("at"), "size").alias("r"))
    grouped = ws.put(located.groupBy("id", "tag").agg(F.collect_list("r").alias("ranges")), "ranges")
    cut = rows.join(grouped, ["id", "tag"], "left").select("id", "body", "ranges").mapInArrow(_cut, "id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return cut.select(F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"), "n_bytes", "spans", "kept")


def digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the rows of ``remove_repeats``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
