"""Vectorised kernels over UTF-8 text in Arrow batches.

They read the value buffer of an Arrow string column in place, in runs of whole
documents of about ``CHUNK_BYTES``, so the memory a task needs follows the longest
document and not the batch. Words are ``[^\\x20\\x09-\\x0D]+``; hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_FOLDED = _BYTE[_LOWER]
_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1024)
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with about ``limit`` bytes; a longer one stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


class Words:
    """The words of a run of documents: byte spans, documents, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, fold: bool):
        base = int(offsets[lo])
        self.text = buf = data[base : int(offsets[hi])]
        self.doc_offsets = off = offsets[lo : hi + 1] - base
        self.n_docs = hi - lo
        solid = ~SPACE[buf]
        before = np.empty_like(solid)
        before[1:] = solid[:-1]
        inner = off[:-1][off[:-1] < len(buf)]
        before[inner] = False
        after = np.empty_like(solid)
        after[:-1] = solid[1:]
        ends_at = off[1:][off[1:] > 0] - 1
        after[ends_at] = False
        if len(buf):
            before[0] = False
            after[-1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        lengths = self.ends - self.starts
        #: word number at which each document begins, and one more
        self.first = np.searchsorted(self.starts, off)
        if not len(self.starts):
            self.hashes = np.zeros(0, dtype=np.uint64)
            return
        at = np.zeros(len(lengths), dtype=np.int64)
        np.cumsum(lengths[:-1], out=at[1:])
        chars = buf[solid]
        place = np.arange(len(chars), dtype=np.int64) - np.repeat(at, lengths)
        table = _BYTE_FOLDED if fold else _BYTE
        sums = np.add.reduceat(table[chars] * powers(int(lengths.max()))[place], at)
        self.hashes = mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one document."""
        w = self.hashes
        if len(w) < n:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        m = len(w) - n + 1
        acc = np.zeros(m, dtype=np.uint64)
        for i in range(n):
            acc *= np.uint64(0x2545F4914F6CDD1D)
            acc += w[i : m + i]
        last = np.searchsorted(self.first, np.arange(m), side="right")
        whole = np.arange(m) + n <= self.first[np.minimum(last, len(self.first) - 1)]
        return mix(acc), whole


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each document; a shorter document is one shingle."""
    grams, _ = words.ngrams(n)
    out = []
    for d in range(words.n_docs):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            acc = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in words.hashes[a:b]:
                    acc = acc * np.uint64(0x2545F4914F6CDD1D) + h
            out.append(mix(np.array([acc], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
