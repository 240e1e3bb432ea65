"""Pair scoring in waves, with every pair scored once; the scorer is a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

PairScorer = Callable[[Column, Column], Column]


def checked(score: Column) -> Column:
    """The score; fails if it is missing or outside 0 to 1."""
    return F.when(score.between(0.0, 1.0), score).otherwise(F.raise_error(F.lit("a pair has no score from 0 to 1")).cast("double"))


def score_pairs(pairs: DataFrame, queries: DataFrame, units: DataFrame, scorer: PairScorer = T.hash_score) -> DataFrame:
    """(qid, uid, score) of the distinct pairs (qid, uid); fails if a score is missing or outside 0 to 1."""
    rows = pairs.select("qid", "uid").distinct().join(queries, "qid").join(units, "uid")
    return rows.select("qid", "uid", F.round(checked(scorer(F.col("query"), F.col("document"))), 9).alias("score"))


def next_wave(requested: DataFrame, scored: DataFrame, queries: DataFrame, units: DataFrame, scorer: PairScorer = T.hash_score) -> DataFrame:
    """All scores after a further wave; pairs that have one are not scored again."""
    new = requested.select("qid", "uid").distinct().join(scored, ["qid", "uid"], "left_anti")
    return scored.withColumn("wave", F.lit(1)).unionByName(score_pairs(new, queries, units, scorer).withColumn("wave", F.lit(2)))


def full_facets(scores: DataFrame, n_facets: DataFrame, least: float = 0.1) -> DataFrame:
    """(qid, full): whether the second wave scores every facet by itself: the intent's best score (qid, uid, score) is under ``least`` and there are facets (qid, n)."""
    best = scores.groupBy("qid").agg(F.max("score").alias("confidence"))
    return n_facets.join(best, "qid", "left").select("qid", ((F.col("n") > 1) & (F.coalesce("confidence", F.lit(0.0)) < least)).alias("full"))


def second_wave(requested: DataFrame, policy: DataFrame) -> DataFrame:
    """(qid, facet, uid) that are scored: as asked where the policy is full, else the intent (facet 0) once for each unit."""
    return requested.join(policy, "qid").select("qid", F.when(F.col("full"), F.col("facet")).otherwise(F.lit(0)).alias("facet"), "uid").distinct()


def chunked(pairs: DataFrame, limit: int = 128) -> DataFrame:
    """(qid, request, uids): the distinct units of each query in requests of at most ``limit`` documents, in the order of their ids."""
    place = F.row_number().over(W.partitionBy("qid").orderBy("uid")) - 1
    dealt = pairs.select("qid", "uid").distinct().withColumn("request", F.floor(place / limit))
    return dealt.groupBy("qid", "request").agg(F.array_sort(F.collect_list("uid")).alias("uids"))


def mapped(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(qid, uid, score) of responses (qid, request, results of (index, relevance_score)) in any order.

    Fails unless each request has exactly one result for each document, with a score from 0 to 1.
    """
    rows = requests.join(responses, ["qid", "request"], "left")
    indices = F.array_sort(F.transform("results", lambda r: r["index"].cast("int")))
    whole = F.coalesce(indices == F.sequence(F.lit(0), F.size("uids") - 1), F.lit(False)) & F.forall("results", lambda r: F.coalesce(r["relevance_score"].between(0.0, 1.0), F.lit(False)))
    checked = F.when(whole, F.col("results")).otherwise(F.raise_error(F.lit("a response does not map to its documents")))
    return rows.select("qid", "uids", F.explode(checked).alias("r")).select("qid", F.get("uids", F.col("r.index").cast("int")).alias("uid"), F.col("r.relevance_score").alias("score"))


def routed_score(score: Column, affinity: Column) -> Column:
    """A facet's score from the intent's score and the unit's affinity to the facet."""
    return score * (0.35 + 0.65 * affinity)


def routed(scores: DataFrame, dense: DataFrame) -> DataFrame:
    """Facet scores from the intent's score (qid, uid, score) and dense (qid, col, uid, d): score * (0.35 + 0.65 * affinity)."""
    best = F.max("d").over(W.partitionBy("qid", "col"))
    near = dense.withColumn("affinity", T.affinity(F.col("d"), best))
    return near.join(scores, ["qid", "uid"]).select("qid", "col", "uid", routed_score(F.col("score"), F.col("affinity")).alias("score"))
