"""MinHash near-duplicate detection with exact confirmation.

Documents whose 5-word shingle sets have a Jaccard similarity of 85 % or more are linked.

1. Equal sets collapse to the smallest document id before anything else is shuffled.
2. ``BANDS`` x ``ROWS`` universal hash minima (multiply-shift) give one key per band. A pair at
   the threshold shares no band with probability (1 - 0.85**5)**26, about 2.4e-7.
3. The documents of a band bucket are tied to the smallest one, not to each other, and these
   ties are closed to families: any two documents of a bucket are in one family.
4. A family is compared inside tasks, in blocks of bounded size, so no pair of documents is
   ever a row. Signatures are verified first (six standard deviations below the threshold),
   then full sets; only pairs that join two parts not yet joined are checked and reported,
   which leaves the components as they are.
5. Components of the confirmed links by large-star and small-star.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; a text
of fewer than five words is one shingle; rows of one id are one node; a null id is compared with
nothing (component null, kept).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import Words, runs, shingle_sets, signed, text_buffer
from .workspace import Workspace

SHINGLE = 5
BANDS, ROWS = 26, 5
THRESHOLD_PERCENT = 85
#: documents and shingles in one block of a family
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000

_rng = np.random.default_rng(7919)
_A = _rng.integers(1, 2**63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2)

_SIGNATURES = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set, 32 bits wide."""
    best = np.full(len(_A), 2**32 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        h = _A[:, None] * shingles[None, at : at + 512]
        h += _B[:, None]
        h >>= np.uint64(32)
        np.minimum(best, h.min(axis=1), out=best)
    return best.astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    acc = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        acc = (acc ^ rows[:, r]) * np.uint64(0x9FB21C651E98DF25)
        acc ^= acc >> np.uint64(29)
    return acc


def _sign(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        n, d1, d2, bands = [], [], [], []
        for lo, hi in runs(offsets):
            for s in shingle_sets(Words(data, offsets, lo, hi, fold=True), SHINGLE):
                n.append(len(s))
                if len(s):
                    d1.append(int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(31))).view(np.int64)))
                    d2.append(int(np.add.reduce((s ^ (s >> np.uint64(27))) * np.uint64(0xD1342543DE82EF95)).view(np.int64)))
                    bands.append(signed(band_keys(minima(s))))
                else:
                    d1.append(None)
                    d2.append(None)
                    bands.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=_SIGNATURES)


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.root[a], self.root[b]
        if x == y:
            return False
        self.root[self.root == max(x, y)] = min(x, y)
        return True


def confirmed_links(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of one block, or of two blocks (``left`` marks the first)."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    ids, sets, sizes = ids[order], [sets[i] for i in order], sizes[order]
    left = None if left is None else left[order]
    marks = np.stack([minima(s) for s in sets]) if n > 2 else None
    least = THRESHOLD_PERCENT / 100 - 6 * np.sqrt(0.15 * 0.85 / (BANDS * ROWS))
    forest, links = _Forest(n), []
    for i in range(1, n):
        lo = int(np.searchsorted(sizes[:i] * 100, THRESHOLD_PERCENT * sizes[i]))
        cand = np.arange(lo, i)
        cand = cand[forest.root[cand] != forest.root[i]]
        if left is not None:
            cand = cand[left[cand] != left[i]]
        if not len(cand):
            continue
        if marks is not None:
            alike = (marks[cand] == marks[i]).mean(axis=1)
            cand, alike = cand[alike >= least], alike[alike >= least]
            cand = cand[np.argsort(-alike, kind="stable")]
        while len(cand):
            # the most alike of each part first; the others only where that fails
            _, pick = np.unique(forest.root[cand], return_index=True)
            for j in cand[np.sort(pick)]:
                shared = int(np.count_nonzero(_found(sets[i], sets[j])))
                if 100 * shared >= THRESHOLD_PERCENT * (sizes[i] + sizes[j] - shared) and forest.join(i, int(j)):
                    links.append((int(ids[i]), int(ids[j])))
            cand = np.delete(cand, pick)
            cand = cand[forest.root[cand] != forest.root[i]]
    return links


def _found(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return a[at] == b


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _confirm(batches):
    """Stream blocks sorted by (family, bi, bj); hold one at a time."""
    key, ids, sets, blocks = None, [], [], []

    def flush():
        left = np.array(blocks) == key[1] if key[1] != key[2] else None
        found = confirmed_links(np.array(ids, dtype=np.int64), sets, left)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=_LINKS)

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        own, block = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        data, offsets = text_buffer(batch.column(5))
        for lo, hi in runs(offsets):
            for i, s in zip(range(lo, hi), shingle_sets(Words(data, offsets, lo, hi, fold=True), SHINGLE), strict=True):
                if keys[i] != key:
                    if len(ids) > 1:
                        yield flush()
                    key, ids, sets, blocks = keys[i], [], [], []
                ids.append(own[i])
                sets.append(s)
                blocks.append(block[i])
    if len(ids) > 1:
        yield flush()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    ws = Workspace(docs.sparkSession, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    signed_rows = ws.put(rows.mapInArrow(_sign, "id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")
    named = signed_rows.where("id is not null and d1 is not null")
    digest = ["d1", "d2", "n_shingles"]
    reps = ws.put(named.groupBy(digest).agg(F.min("id").alias("rep")), "classes")

    heads = named.join(reps.withColumnRenamed("rep", "id"), [*digest, "id"]).select("id", "bands")
    keys = heads.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("band", "key").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head < tail").drop("tail")
    ties = keys.join(buckets, ["band", "key"]).where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v"))
    # an id with several texts holds their classes together
    split = named.join(reps, digest).groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    same_id = ws.put(split.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(split.select(F.col("id").alias("u"), F.col("b").alias("v"))), "same-id")
    families = ws.put(connected_components(ties, ws, "families"), "families").withColumnRenamed("component", "family")

    members = families.join(named.join(reps.withColumnRenamed("rep", "id"), [*digest, "id"]).groupBy(F.col("id").alias("node")).agg(F.max("n_shingles").alias("n")), "node")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = families.join(sizes, "family").select("node", "family", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    work = (
        rows.join(placed, rows.id == placed.node)
        .select("family", "block", "id", "body", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("family", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "id", "block", "body")
        .repartition("family", "bi", "bj")
        .sortWithinPartitions("family", "bi", "bj", "id")
    )
    links = ws.put(work.mapInArrow(_confirm, "u long, v long"), "links")
    parts = ws.put(connected_components(links.unionByName(same_id), ws, "parts"), "components")
    named_rows = signed_rows.join(reps, digest, "left").join(parts, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return named_rows.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


#: DuckDB SQL of the registered query: every pair that shares a shingle, and the least document reachable
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)
), r(node, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT b.v, r.root FROM r JOIN (SELECT u, v FROM e UNION ALL SELECT v, u FROM e) b ON b.u = r.node WHERE r.root < b.v
), c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
