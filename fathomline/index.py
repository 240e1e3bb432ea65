"""An index of units that is built once, restored with checks, and searched by tables of queries.

    index = build(units, "hdfs:///indexes/code")      # or open_index(spark, root)
    found = search(index, queries, budget=8000)       # (qid, query) in, ranked units out

Terms are counted where the texts stand; lengths are taken from the written postings. A build
whose identity is already published is a restore. With a previous index, units whose features did
not change keep their postings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .operators import recall, scoring
from .sources import store

VERSION = "hybrid-1"
DEPTH, POOL = 40, 28
MAX_QUERY, MIN_BUDGET, MAX_BUDGET = 8192, 256, 8000
COLUMNS = ["uid", "path", "symbol", "language", "kind", "start", "text"]

#: (uid, text) to (uid, vec)
Embedder = Callable[[DataFrame], DataFrame]


class BadIndex(ValueError):
    """A published index that does not fit its description."""


@dataclass(frozen=True)
class Index:
    info: dict
    units: DataFrame
    postings: DataFrame
    lengths: DataFrame
    vectors: DataFrame
    cache_hit: bool = False


def identity_of(units: DataFrame, version: str = VERSION) -> str:
    """A digest of all rows in any order: their number, and the sums of two hashes of each."""
    row = units.select(F.xxhash64(*units.columns).alias("a"), F.hash(*units.columns).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("x"), F.sum(F.pmod("a", F.lit(1 << 31))).alias("s"), F.sum("b").alias("t")).first()
    return f"{version}-{row['n']}-{(row['x'] or 0) & (2**64 - 1):016x}-{row['s'] or 0:x}-{(row['t'] or 0) & (2**64 - 1):x}"


def weighted_body() -> Column:
    """What is indexed of a unit: its path and symbol three times, and its text."""
    return F.concat(F.repeat(F.concat(F.col("path"), F.lit(" "), F.col("symbol"), F.lit(" ")), 3), F.col("text"))


def build(units: DataFrame, root: str, body: Column | None = None, embed: Embedder | None = None, previous: Index | None = None) -> Index:
    """Publish an index of units (``COLUMNS``; uid distinct) below ``root``, or restore it if it is there already."""
    spark = units.sparkSession
    rows = units.select(*COLUMNS)
    identity = identity_of(rows)
    if store.published(spark, root) and store.description(spark, root).get("identity") == identity:
        found = open_index(spark, root)
        return Index(found.info, found.units, found.postings, found.lengths, found.vectors, True)
    body = weighted_body() if body is None else body
    version = store.begin(spark, root)
    ready = store.put(rows.select(*COLUMNS, T.token_cost(F.col("text")).cast("long").alias("cost"), F.sha2(F.coalesce(body, F.lit("")), 256).alias("feature")), f"{root}/{version}/units")
    if previous is None:
        counted = recall.text_postings(rows, body)
    else:
        old = previous.units.groupBy("feature").agg(F.min("uid").alias("old"))
        known = ready.join(old, "feature").select("uid", "old")
        kept = previous.postings.withColumnRenamed("uid", "old").join(known, "old").select("uid", "term", "tf")
        counted = kept.unionByName(recall.text_postings(rows.join(known, "uid", "left_anti"), body))
    postings = store.put(counted, f"{root}/{version}/postings")
    sizes = ready.select("uid").join(postings.groupBy("uid").agg(F.sum("tf").alias("len")), "uid", "left").select("uid", F.coalesce("len", F.lit(0)).cast("long").alias("len"))
    lengths = store.put(sizes, f"{root}/{version}/lengths")
    found = recall.text_vectors(rows, body) if embed is None else embed(ready.select("uid", "text"))
    vectors = store.put(found, f"{root}/{version}/vectors")
    n_vectors, dims, finite = _vector_facts(vectors)
    if not finite:
        raise BadIndex("vectors of unequal length or with values that are not finite")
    info = {"identity": identity, "units": ready.count(), "postings": postings.count(), "vectors": n_vectors, "dims": dims, "languages": {r["language"]: r["n"] for r in ready.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}}
    store.finish(spark, root, version, info)
    return Index(info | {"version": version}, ready, postings, lengths, vectors)


def _vector_facts(vectors: DataFrame) -> tuple[int, int, bool]:
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"), F.min(sound).alias("sound")).first()
    return row["n"], row["high"] or 0, row["n"] == 0 or (row["low"] == row["high"] and row["sound"])


def open_index(spark: SparkSession, root: str, identity: str | None = None, check: bool = True) -> Index:
    """The published index; raises ``BadIndex`` if it has another identity or does not fit its description."""
    info, tables = store.current(spark, root)
    if identity is not None and info.get("identity") != identity:
        raise BadIndex(f"the published index is {info.get('identity')}")
    if missing := {"units", "postings", "lengths", "vectors"} - set(tables):
        raise BadIndex(f"the published index has no {sorted(missing)}")
    index = Index(info, *(tables[k] for k in ("units", "postings", "lengths", "vectors")))
    if check:
        have = {"units": index.units.count(), "postings": index.postings.count(), "vectors": index.vectors.count()}
        if wrong := {k: n for k, n in have.items() if n != info[k]}:
            raise BadIndex(f"rows differ from the description: {wrong}")
        if not _vector_facts(index.vectors)[2]:
            raise BadIndex("vectors of unequal length or with values that are not finite")
    return index


def query_vectors(queries: DataFrame) -> DataFrame:
    """(qid, vec): hashed vectors of queries, as an index without an embedder has them of units."""
    said = recall.postings(queries.withColumnRenamed("qid", "uid"), F.col("query")).withColumnRenamed("uid", "qid")
    return recall.hashed_vectors(said, "qid")


def search(index: Index, queries: DataFrame, budget: int = MAX_BUDGET, vectors: DataFrame | None = None, scorer: scoring.PairScorer = T.hash_score, document: Column | None = None) -> DataFrame:
    """(qid, uid, path, language, score, role_rank, spent) of the units that fit the budget of each query (qid, query).

    Lexical and dense recall, rank fusion, pair scores, ranks within a language, and the prefix of
    the budget. ``vectors`` are the queries' (qid, vec); by default they are hashed. Queries over
    ``MAX_QUERY`` characters and budgets outside ``MIN_BUDGET`` to ``MAX_BUDGET`` are errors.
    """
    if not MIN_BUDGET <= budget <= MAX_BUDGET:
        raise ValueError(f"budget must be from {MIN_BUDGET} to {MAX_BUDGET}")
    asked = queries.select("qid", F.when(F.length("query") <= MAX_QUERY, F.col("query")).otherwise(F.raise_error(F.lit("a query is too long")).cast("string")).alias("query"))
    (lexical,) = recall.lexical_tops(recall.Counts(index.postings, index.lengths), asked, [(DEPTH, None)])
    dense = recall.dense_top(index.vectors, query_vectors(asked) if vectors is None else vectors, DEPTH)
    pool = recall.rrf(lexical, dense, pool=POOL).select("qid", "uid")
    shown = T.document(F.col("path"), F.col("symbol"), F.col("text"), 5000) if document is None else document
    met = pool.join(index.units, "uid").join(asked, "qid")
    scored = met.select("qid", "uid", "path", "language", "cost", F.round(scoring.checked(scorer(F.col("query"), shown)), 9).alias("score"))
    best = (F.desc("score"), F.col("uid"))
    spent = F.sum("cost").over(W.partitionBy("qid").orderBy(*best).rowsBetween(W.unboundedPreceding, 0))
    rank = F.row_number().over(W.partitionBy("qid", "language").orderBy(*best)) - 1
    return scored.select("qid", "uid", "path", "language", "score", rank.alias("role_rank"), spent.alias("spent")).where(F.col("spent") <= budget)


def status(spark: SparkSession, root: str) -> dict:
    """What is published below ``root``: phase ``empty`` or ``ready``, and the description."""
    if not store.published(spark, root):
        return {"phase": "empty"}
    return {"phase": "ready", **store.description(spark, root)}
