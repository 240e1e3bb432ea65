"""Benchmark decontamination with spaced seeds.

Words are ``[^\\x20\\x09-\\x0D]+`` in ASCII lower case. Each mask of ``MASKS`` marks the positions
of an 11-word window that count; the others may differ. The masked windows of the benchmark are
hashed once and held against those of every document. Around each hit the document and the item
are compared word for word on the hit's diagonal. A document is contaminated by an item if any
stretch there has at least ``MIN_MATCH`` agreeing words (all words of a shorter item) and at
least ``MIN_PERCENT`` % of its words agree. Reported is the stretch of the best score (a word that
agrees counts 1, one that differs costs 3); where that one falls short, the stretch with the most
agreeing words among those that meet the percentage.

The benchmark reaches the executors in blocks of about ``BLOCK_WORDS`` words, whose size is counted
before anything is sent; each block is held against all documents. With several blocks the hits of
one are written and its index is destroyed before the next is made, so one block at a time is held.
Documents are not shuffled, so a hot source or item cannot overload a task; only the removal by
several blocks ends with one anti-join on a digest of the text.

Defined cases: null and empty texts and items match nothing; items of one id are compared
separately and reported under that id; items shorter than a mask are looked up whole; rows of one
id are one document with its best overlap; of equal overlaps the one that begins first in the
document counts; without documents or items nothing is found; no other column is read, whatever
its name, and the removal keeps all of them.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, mix, runs, text_buffer
from .workspace import Workspace

MASKS = ("11101001011", "11001101101", "10110110011", "11011010101")
MIN_MATCH, MIN_PERCENT = 13, 80
MISMATCH_COST = 3
#: words of benchmark text in one broadcast: 8 bytes each, 16 for each of their seeds
BLOCK_WORDS = 1_000_000
_BITS = 22


def _seeds(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    m = len(hashes) - len(mask) + 1
    acc = np.full(max(0, m), salt, dtype=np.uint64)
    for i, keep in enumerate(mask):
        if keep == "1" and m > 0:
            acc *= np.uint64(0x2545F4914F6CDD1D)
            acc += hashes[i : m + i]
    return mix(acc)


class Index:
    """The hashed words and seeds of some benchmark items."""

    def __init__(self, ids: list, texts: list[str | None]):
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        words = Words(data, offsets, 0, len(texts), fold=True)
        self.ids, self.words, self.first = ids, words.hashes, words.first
        sizes = np.diff(self.first)
        found = []
        # items shorter than a mask have one seed, of all their words
        self.masks = [*MASKS, *("1" * n for n in sorted({int(n) for n in sizes if 0 < n < len(MASKS[0])}))]
        for k, mask in enumerate(self.masks):
            s = _seeds(self.words, mask, k + 1)
            at = np.arange(len(s))
            item = np.searchsorted(self.first, at, side="right") - 1
            size = sizes[np.minimum(item, len(sizes) - 1)] if len(sizes) else at
            whole = at + len(mask) <= self.first[np.minimum(item + 1, len(self.first) - 1)]
            fits = whole & ((size == len(mask)) if k >= len(MASKS) else True)
            found.append((s[fits], at[fits]))
        seeds = np.concatenate([s for s, _ in found]) if found else np.zeros(0, dtype=np.uint64)
        at = np.concatenate([a for _, a in found]) if found else np.zeros(0, dtype=np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.at = seeds[order], at[order]
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def overlaps(self, words: Words) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item, document word, item word, length, agreeing words): the best stretch of each pair."""
        if not len(self.seeds) or not len(words.hashes):
            return []
        where, what = [], []
        for k, mask in enumerate(self.masks):
            s = _seeds(words.hashes, mask, k + 1)
            p = np.flatnonzero(self.filter[(s >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.seeds, s[p], "left"), np.searchsorted(self.seeds, s[p], "right")
            n = hi - lo
            p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
            where.append(np.repeat(p, n))
            what.append(self.at[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        where, what = np.concatenate(where), np.concatenate(what)
        doc = np.searchsorted(words.first, where, side="right") - 1
        item = np.searchsorted(self.first, what, side="right") - 1
        best: dict[tuple[int, int], tuple] = {}
        for d, i, shift in np.unique(np.stack([doc, item, where - what]), axis=1).T.tolist() if len(where) else []:
            a = max(int(words.first[d]), int(self.first[i]) + shift)
            b = min(int(words.first[d + 1]), int(self.first[i + 1]) + shift)
            if b <= a:
                continue
            same = words.hashes[a:b] == self.words[a - shift : b - shift]
            need = min(MIN_MATCH, int(self.first[i + 1] - self.first[i]))
            if same.sum() < need:
                continue
            for scored, stretch in ((True, _best_stretch), (False, _widest_stretch)):
                start, stop = stretch(same)
                agree = int(same[start:stop].sum())
                if agree >= need and 100 * agree >= MIN_PERCENT * (stop - start):
                    row = (scored, agree, -(stop - start), -(a + start - int(words.first[d])), -(a - shift + start - int(self.first[i])))
                    best[d, i] = max(row, best.get((d, i), row))
                    break
        return [(d, i, -r[3], -r[4], -r[2], r[1]) for (d, i), r in best.items()]


def _best_stretch(same: np.ndarray) -> tuple[int, int]:
    """The stretch of the largest score; the first of equals."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH_COST))])
    low = np.minimum.accumulate(total)
    stop = int(np.argmax(total - low))
    start = int(np.argmin(total[: stop + 1]))
    return start, stop


def _widest_stretch(same: np.ndarray) -> tuple[int, int]:
    """The stretch with the most agreeing words of which ``MIN_PERCENT`` % agree; the shortest, then the first of equals."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 100 - MIN_PERCENT, -MIN_PERCENT))])
    agree = np.concatenate([[0], np.cumsum(same)])
    # for each agreeing word as the last one, the earliest start that meets the percentage
    stop = np.flatnonzero(same) + 1
    start = np.searchsorted(-np.minimum.accumulate(total), -total[stop], "left")
    start = (stop - 1)[agree[start]]
    k = np.lexsort((start, stop - start, agree[start] - agree[stop]))[0]
    return int(start[k]), int(stop[k])


_HITS = [("item_id", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64()), ("n_match", pa.int64())]


def _finder(index):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for lo, hi in runs(offsets):
                for d, i, at, start, size, agree in index.value.overlaps(Words(data, offsets, lo, hi, fold=True)):
                    for column, x in zip(rows, (lo + d, index.value.ids[i], at, start, size, agree), strict=True):
                        column.append(x)
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, (_, t) in zip(rows[1:], _HITS, strict=True))], names=["doc_id", *(n for n, _ in _HITS)])

    return run


def _sieve(index, n_columns: int, wanted: bool):
    """Of rows with a text after ``n_columns`` columns, those that are clean or (``wanted`` false) those that are not."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(n_columns))
            clean = np.ones(batch.num_rows, dtype=bool)
            for lo, hi in runs(offsets):
                for d, *_ in index.value.overlaps(Words(data, offsets, lo, hi, fold=True)):
                    clean[lo + d] = False
            yield pa.RecordBatch.from_arrays(batch.columns[:n_columns], names=batch.schema.names[:n_columns]).filter(pa.array(clean == wanted))

    return run


def _by_blocks(benchmark: DataFrame, item_col: str, text_col: str, make) -> list[DataFrame]:
    """``make`` of the broadcast index of each block; with several, each is written before the next index is made."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("body")).where("body is not null").distinct()
    # a word takes two bytes at least, with the space after it
    total = items.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / 2 / BLOCK_WORDS))
    ws, out = Workspace(spark, "decontaminate"), []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == k).orderBy("item", "body").collect()
        index = spark.sparkContext.broadcast(Index([r["item"] for r in rows], [r["body"] for r in rows]))
        if n == 1:
            return [make(index)]
        out.append(ws.put(make(index), f"block-{k}"))
        index.destroy()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words, n_match: the best overlap of each contaminated document and item."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    schema = ", ".join(["doc_id long", *(f"{n} long" for n, _ in _HITS)])
    found = reduce(DataFrame.unionByName, _by_blocks(benchmark, item_col, item_text_col, lambda index: rows.mapInArrow(_finder(index), schema)))
    best = F.max(F.struct("n_match", (-F.col("n_words")).alias("a"), (-F.col("doc_word")).alias("b"), (-F.col("item_word")).alias("c"))).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("x.b")).alias("doc_word"), (-F.col("x.c")).alias("item_word"), (-F.col("x.a")).alias("n_words"), F.col("x.n_match").alias("n_match"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their columns."""
    own = {f"c{k}": c for k, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(k) for k, c in own.items()], F.col(text_col).alias("body"))
    names = [F.xxhash64("body").alias("h1"), F.xxhash64("body", F.lit(1)).alias("h2")]
    whole = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])
    single = []

    def make(index):
        single.append(rows.mapInArrow(_sieve(index, len(own), True), whole))
        return rows.select(*names, "body").mapInArrow(_sieve(index, 2, False), "h1 long, h2 long")

    gone = _by_blocks(benchmark, item_col, item_text_col, make)
    if len(gone) == 1:
        kept = single[0]
    else:
        kept = rows.withColumns({"h1": names[0], "h2": names[1]}).join(reduce(DataFrame.unionByName, gone).distinct(), ["h1", "h2"], "left_anti")
    return kept.select(*[F.col(k).alias(c) for k, c in own.items()])
