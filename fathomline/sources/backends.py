"""Embedding and scoring services, asked in batches from the tasks.

A backend is a function of a list of texts (or of a query and a list of documents), so tests and
offline runs pass their own; ``HttpEmbedder`` and ``HttpScorer`` speak the usual JSON dialects.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

TRIES, PAUSE = 3, 0.5
#: fixed values: replies that are worth another try
TRANSIENT = {408, 429, 500, 502, 503, 504}
BATCH, SLICES = 20, 8

Post = Callable[[str, dict, str | None, float], dict]


def http_post(url: str, body: dict, key: str | None, timeout: float) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as reply:
        return json.load(reply)


def with_retries(call: Callable[[], dict], tries: int = TRIES, pause: float = PAUSE) -> dict:
    """Repeat on time-outs, lost connections and transient statuses, each time after a longer pause; other errors go through."""
    for k in range(1, tries + 1):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code not in TRANSIENT or k == tries:
                raise
        except (TimeoutError, ConnectionError, urllib.error.URLError):
            if k == tries:
                raise
        time.sleep(pause * k)
    raise AssertionError("not reached")


def matrix_of(reply: dict, n: int, dims: int | None) -> np.ndarray:
    """The vectors of a reply (index, embedding in any order) in order; raises unless there are n of equal, finite shape."""
    rows = sorted(reply["data"], key=lambda r: r["index"])
    if [r["index"] for r in rows] != list(range(n)):
        raise ValueError("the reply does not have one vector for each text")
    found = np.array([r["embedding"] for r in rows], dtype=np.float32)
    if found.ndim != 2 or (dims is not None and found.shape[1] != dims) or not np.isfinite(found).all():
        raise ValueError("the reply's vectors have a wrong shape or values that are not finite")
    return found


@dataclass(frozen=True)
class HttpEmbedder:
    url: str
    model: str
    key: str | None = None
    dims: int | None = None
    timeout: float = 60
    post: Post = http_post

    def __call__(self, texts: list[str]) -> np.ndarray:
        body = {"model": self.model, "input": texts}
        return matrix_of(with_retries(lambda: self.post(f"{self.url.rstrip('/')}/embeddings", body, self.key, self.timeout)), len(texts), self.dims)


@dataclass(frozen=True)
class HttpScorer:
    """``dialect``: ``rerank`` (query, documents, top_n) or ``nested`` (the same below input and parameters, results below output)."""

    url: str
    model: str
    key: str | None = None
    dialect: str = "rerank"
    timeout: float = 60
    post: Post = http_post

    def __call__(self, query: str, documents: list[str]) -> list[float]:
        asked = {"query": query, "documents": documents}
        nested = self.dialect == "nested"
        body = {"model": self.model, "input": asked, "parameters": {"top_n": len(documents)}} if nested else {"model": self.model, **asked, "top_n": len(documents)}
        reply = with_retries(lambda: self.post(self.url, body, self.key, self.timeout))
        return scores_of(reply["output"] if nested else reply, len(documents))


def scores_of(reply: dict, n: int) -> list[float]:
    """Scores in the order of the documents; raises unless each has one from 0 to 1."""
    found = {r["index"]: float(r["relevance_score"]) for r in reply["results"]}
    if len(reply["results"]) != n or set(found) != set(range(n)) or not all(math.isfinite(x) and 0 <= x <= 1 for x in found.values()):
        raise ValueError("the reply does not have one score from 0 to 1 for each document")
    return [found[k] for k in range(n)]


def batch_scores(reply: dict, pairs: list[tuple[int, int]]) -> list[float]:
    """Scores of a batch reply in the order of its pairs; raises if a row names another pair."""
    rows = {r["index"]: r for r in reply["results"]}
    if len(reply["results"]) != len(pairs) or set(rows) != set(range(len(pairs))):
        raise ValueError("the reply does not have one score for each pair")
    for k, (q, d) in enumerate(pairs):
        if (rows[k]["query_index"], rows[k]["document_index"]) != (q, d):
            raise ValueError("the reply's pairs are not those that were asked for")
    return [float(rows[k]["relevance_score"]) for k in range(len(pairs))]


def embedded(rows: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = BATCH, key: str = "key") -> DataFrame:
    """(key, vec) of rows (key, text); each task asks for ``batch`` texts at a time. Failed tasks are repeated by Spark."""

    def run(batches):
        for got in batches:
            for at in range(0, got.num_rows, batch):
                part = got.slice(at, batch)
                found = np.asarray(embed([t or "" for t in part.column(1).to_pylist()]), dtype=np.float32)
                if found.shape[0] != part.num_rows or not np.isfinite(found).all():
                    raise ValueError("an embedder gave too few vectors or values that are not finite")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), found.shape[1]).cast(pa.list_(pa.float32()))], names=[key, "vec"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, vec array<float>")


def embed_missing(root: str, rows: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = BATCH, slices: int = SLICES) -> int:
    """Embed the texts (key, text) whose key the vector store lacks and append them; returns how many.

    Keys go in ``slices``, each of which is appended when it is done: after a failure the next call goes on with what is left.
    """
    missing = store.missing(root, rows.dropDuplicates(["key"]))
    n = 0
    for k in range(slices):
        n += store.put_missing(root, embedded(missing.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == k), embed, batch))
    return n


def vectors_of(blobs: DataFrame) -> DataFrame:
    """(key, vec) of legacy rows (key, blob): little-endian 32-bit floats; lengths that are no multiple of four are errors."""

    def run(batches):
        for got in batches:
            found = [np.frombuffer(b, dtype="<f4").tolist() if b is not None else None for b in got.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(found, pa.list_(pa.float32()))], names=["key", "vec"])

    kind = dict(blobs.dtypes)["key"]
    return blobs.select("key", "blob").mapInArrow(run, f"key {kind}, vec array<float>")
