"""The terms of ``text.terms`` for many texts at once, on the bytes of Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that are taken apart at once
STRETCH = 1 << 23

_LOWER = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum():
        _LOWER[_c] = ord(chr(_c).lower())
#: letters beyond ASCII whose lower case has ASCII letters, and the bytes, of no other letter, that stand for them
_ODD = {"\u0130".encode(): b"\xfe\x80", "\u212a".encode(): b"\xff"}
_LOWER[0xFE], _LOWER[0xFF] = ord("i"), ord("k")


def _plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of texts; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    for letter, lower in _ODD.items():
        if pc.any(pc.match_substring(texts, letter)).as_py():
            texts = pc.replace_substring(texts, letter, lower)
    _, where, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(where, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return offsets - offsets[0], np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(rows, terms): the terms of all texts in order, with the place of their text."""
    offsets, data = _plain(texts)
    low = _LOWER[data]
    n = len(low)
    inside = low > 0
    fresh = np.ones(n + 1, dtype=bool)
    # a run begins where the one before ends, at an upper-case letter after a lower-case one, and at a text's start
    camel = (data[1:] >= 65) & (data[1:] <= 90) & (data[:-1] >= 97) & (data[:-1] <= 122)
    fresh[1:n] = ~inside[:-1] | camel
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:n])
    last = inside & (~np.append(inside[1:], False) | fresh[1:])
    ends = np.flatnonzero(last) + 1
    digit = low[starts] < 97
    if digit.any():  # a term begins at the run's first letter
        letters = np.append(np.flatnonzero(low >= 97), n)
        starts[digit] = np.minimum(letters[np.searchsorted(letters, starts[digit])], ends[digit])
    long = ends - starts >= 2
    starts, ends = starts[long], ends[long]
    mark = np.zeros(n + 1, dtype=np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    places = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=places[1:])
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(low[np.cumsum(mark[:n], dtype=np.int8) > 0]))
    return np.searchsorted(offsets, starts, side="right") - 1, terms


def stretches(batches) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of batches (id, text), some ``STRETCH`` bytes at a time."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = size[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(size, before + STRETCH, side="right")))
            yield batch.column(0).slice(first, stop - first), batch.column(1).slice(first, stop - first)
            first = stop
