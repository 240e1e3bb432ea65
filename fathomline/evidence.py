"""Evidence for requests: recall, three waves of pair scores along relations, and a packer, for a table of requests at once.

    found = gather(index, relations, queries, budget=8000)     # (qid, position, uid, path, phase, cost, spent)
    shown = context(index, found)                              # (qid, context): the chosen source, numbered

A request is asked as its intent and up to four facets. What recall finds is scored; what the best
units call or are called by, and the other parts of their functions, are scored after it, every pair
once. Candidates of a request are bounded by the lanes below, so one packer task holds some hundreds.

Defined cases: a request that is null or finds nothing has no rows; equal scores go to the smaller
uid; relations to units that the index does not have are passed over; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .index import MAX_QUERY, Embedder, Index, query_vectors
from .operators import graph, packing, recall, scoring
from .sources.shared import cut

#: fixed values: units of a channel, of a channel within the languages asked for, best units of a prompt
#: and of the role asked for, neighbours of a request, callees of a test that lend it weight, their share
LANE, SCOPED_LANE, BEST, BEST_IN_ROLE, NEIGHBOURS, MOST_TARGETS, TEST_SHARE = 40, 80, 8, 6, 80, 8, 0.3
LINKS, CALLS, CALLABLE = ["calls", "same_symbol", "references_value"], ["calls", "references_value"], ["function", "method"]
DOC_REFERENCE = "explicit-doc-reference"
#: a prompt's number is the request's shifted by these bits, and its place
_BITS = 3


def prompts(queries: DataFrame) -> DataFrame:
    """(qid, pid, col, intent, query) of requests (qid, query): the intent as col 0, then its facets with it as context."""
    intent = F.when(F.length("query") <= MAX_QUERY, F.col("query")).otherwise(F.raise_error(F.lit("a query is too long")).cast("string"))
    rows = queries.where("query is not null").select("qid", intent.alias("intent"))
    said = T.prompts(F.col("intent"), F.transform(T.facets(F.col("intent")), lambda f: f["question"]))
    return rows.select("qid", "intent", F.posexplode(said).alias("col", "query")).select("qid", (F.col("qid") * 2**_BITS + F.col("col")).alias("pid"), "col", "intent", "query")


def recalled(index: Index, asked: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """(qid, uid): the best of each prompt by terms and by vectors, and of the languages that the request names."""
    said = asked.select(F.col("pid").alias("qid"), "query")
    if embed is None:
        vectors = query_vectors(said)
    else:
        vectors = embed(asked.select(F.col("pid").alias("uid"), F.concat(F.lit(T.INSTRUCTION), "query").alias("text"))).select(F.col("uid").alias("qid"), "vec")
    vectors = cut(vectors)
    named = cut(asked.select(F.col("pid").alias("qid"), F.explode(T.requested_languages(F.col("intent"))).alias("language")))
    homes = index.units.select("uid", "language")
    languages = sorted(one for (one,) in named.select("language").distinct().collect())
    lexical, *scoped = recall.lexical_tops(recall.Counts(index.postings, index.lengths), said, [(LANE, None), *((SCOPED_LANE, homes.where(F.col("language") == one)) for one in languages)])
    lanes = [lexical, recall.dense_top(index.vectors, vectors, LANE)]
    # as many rounds as languages are named, at most those that requests can name
    near = [recall.dense_top(index.vectors.join(homes.where(F.col("language") == one), "uid", "left_semi"), vectors.join(named.where(F.col("language") == one), "qid", "left_semi"), SCOPED_LANE).drop("rank") for one in languages]
    scoped = [lane.join(named.where(F.col("language") == one), "qid", "left_semi").drop("rank") for one, lane in zip(languages, scoped, strict=True)]
    lanes += [recall.top(reduce(DataFrame.unionByName, each), SCOPED_LANE) for each in (scoped, near) if each]
    found = None
    for lane in lanes:
        part = lane.select(F.shiftright("qid", _BITS).alias("qid"), "uid")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _wave(index: Index, pairs: DataFrame, asked: DataFrame, scorer: scoring.PairScorer) -> DataFrame:
    """Scores of pairs (qid, uid) for every prompt of the request, with what the packer needs of a unit."""
    met = pairs.join(index.units, "uid").join(asked, "qid")
    role, languages = T.source_role(F.col("path"), F.col("language")), T.requested_languages(F.col("intent"))
    shown = T.document(F.col("path"), F.col("symbol"), F.col("text"), 5000)
    return cut(
        met.select(
            *("qid", "uid", "col", "path", "symbol", "kind", "cost"),
            role.alias("role"),
            T.requested_role(F.col("intent")).alias("primary"),
            T.wants_tests(F.col("intent")).alias("tests"),
            ((F.size(languages) == 0) | F.array_contains(languages, F.col("language"))).alias("scoped"),
            T.substance_for(F.col("intent"), role, F.col("kind"), F.col("text")).alias("substance"),
            F.round(scoring.checked(scorer(F.col("query"), shown)), 9).alias("score"),
        )
    )


def _explains() -> Column:
    return (F.col("role") == F.col("primary")) & (F.col("substance") >= packing.SUBSTANCE)


def neighbours(scored: DataFrame, relations: DataFrame) -> DataFrame:
    """(qid, uid): the units beside the best of each prompt that are best supported and not scored yet.

    A unit shares its best score among its neighbours; one with over ``graph.HUB`` of them only reaches those it calls.
    """
    by_score = (F.desc("score"), F.col("uid"))
    placed = scored.withColumn("fit", _explains()).withColumn("k", F.row_number().over(W.partitionBy("qid", "col").orderBy(*by_score)))
    placed = placed.withColumn("m", F.row_number().over(W.partitionBy("qid", "col", "fit").orderBy(*by_score)))
    marked = placed.groupBy("qid", "uid").agg(F.max("score").alias("confidence"), F.max((F.col("k") <= BEST) | (F.col("fit") & (F.col("m") <= BEST_IN_ROLE))).alias("seed"))
    seeds = marked.where("seed").select("qid", F.col("uid").alias("src"), "confidence")
    out = relations.where(F.col("kind").isin(LINKS)).select("src", "dst", F.col("kind").isin(CALLS).cast("int").alias("out"))
    both = out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("out")))
    near = both.join(seeds.select("src").distinct(), "src", "left_semi").groupBy("src", "dst").agg(F.max("out").alias("out"))
    fan = near.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("out").alias("n_out"))
    open_ = near.join(fan, "src").where((F.col("n") <= graph.HUB) | (F.col("out") == 1)).select("src", F.col("dst").alias("uid"), F.when(F.col("n") <= graph.HUB, F.col("n")).otherwise(F.col("n_out")).alias("n"))
    support = seeds.join(open_, "src").groupBy("qid", "uid").agg(F.round(F.max(F.col("confidence") / F.col("n")), 12).alias("support"))
    new = support.join(marked.select("qid", "uid"), ["qid", "uid"], "left_anti")
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("support"), "uid"))
    return new.withColumn("k", place).where(F.col("k") <= NEIGHBOURS).select("qid", "uid")


def _small_families(index: Index, scored: DataFrame) -> DataFrame:
    """(symbol) of functions and methods among the scored units whose parts together cost little."""
    asked = scored.where(F.col("kind").isin(CALLABLE)).select("symbol").distinct()
    return index.units.join(asked, "symbol", "left_semi").groupBy("symbol").agg(F.sum("cost").alias("total")).where(F.col("total") <= packing.FAMILY_COST).select("symbol")


def worth(scored: DataFrame, calls: DataFrame) -> DataFrame:
    """(qid, uid, worth): a unit's value for each prompt, and a share of what the tests that call it are worth.

    Values fall with the rank among the units of one role. A test lends its strength over the root of its targets.
    """
    rank = F.row_number().over(W.partitionBy("qid", "col", "role").orderBy(F.desc("score"), "uid")) - 1
    intent = F.max(F.when(F.col("col") == 0, F.col("score"))).over(W.partitionBy("qid", "uid"))
    valued = scored.withColumn("rank", rank).withColumn("value", T.value(F.col("score"), F.col("rank"), F.col("substance"), intent, F.col("scoped")))
    first = scored.where("col = 0")
    testing = first.where("role = 'test'").select("qid", F.col("uid").alias("src"))
    tested = first.where("role = 'implementation'").select("qid", F.col("uid").alias("dst"))
    met = testing.join(calls, "src").join(tested, ["qid", "dst"]).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("qid", "src"))).where(F.col("n") <= MOST_TARGETS)
    said = valued.where("role = 'test' and score >= 0.1").select("qid", "col", F.col("uid").alias("src"), (F.col("score") * 0.5 + F.exp(-F.col("rank") / 8) * 0.5).alias("strength"))
    lent = met.join(said, ["qid", "src"]).groupBy("qid", "col", F.col("dst").alias("uid")).agg(F.max(F.col("strength") / F.sqrt("n")).alias("lent"))
    whole = valued.join(lent, ["qid", "col", "uid"], "left").select("qid", "uid", F.struct("col", (F.col("value") + TEST_SHARE * F.coalesce("lent", F.lit(0.0))).alias("w")).alias("x"))
    return whole.groupBy("qid", "uid").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.round(x["w"], 12)).alias("worth"))


def _targets(edges: DataFrame, first: DataFrame, name: str) -> DataFrame:
    """(qid, uid, name): where edges (src, dst) lead among a request's candidates."""
    met = first.select("qid", F.col("uid").alias("src")).join(edges, "src").join(first.select("qid", F.col("uid").alias("dst")), ["qid", "dst"])
    return met.groupBy("qid", F.col("src").alias("uid")).agg(F.array_sort(F.collect_set("dst")).alias(name))


def candidates(index: Index, relations: DataFrame, queries: DataFrame, embed: Embedder | None = None, scorer: scoring.PairScorer = T.hash_score) -> DataFrame:
    """What ``packing.pack_evidence`` chooses from: every unit that was scored for a request (qid, query).

    ``relations`` are (src, dst, kind, resolution) between the index's units.
    """
    asked = cut(prompts(queries))
    known = _wave(index, recalled(index, asked, embed), asked, scorer)
    known = known.unionByName(_wave(index, neighbours(known, relations), asked, scorer))
    families = cut(_small_families(index, known))
    parts = index.units.join(families, "symbol", "left_semi").select("uid", "symbol")
    asked_for = known.where(F.col("kind").isin(CALLABLE)).select("qid", "symbol").distinct()
    others = asked_for.join(parts, "symbol").select("qid", "uid").distinct().join(known.select("qid", "uid"), ["qid", "uid"], "left_anti")
    known = known.unionByName(_wave(index, others, asked, scorer))
    calls = relations.where(F.col("kind").isin(CALLS)).select("src", "dst").distinct()
    notes = relations.where(F.col("kind").isin(LINKS) & (F.col("resolution") == DOC_REFERENCE)).select("src", "dst").distinct()
    first = known.where("col = 0").drop("col")
    none = F.array().cast("array<bigint>")
    ready = first.withColumnRenamed("score", "intent").join(worth(known, calls), ["qid", "uid"])
    ready = ready.join(_targets(calls, first, "callees"), ["qid", "uid"], "left").join(_targets(notes, first, "notes"), ["qid", "uid"], "left")
    small = families.select("symbol", F.lit(True).alias("small"))
    return ready.join(small, "symbol", "left").select(
        *("qid", "uid", "path", "symbol", "cost", "role", "primary", "tests", "substance", "intent", "worth"),
        F.coalesce("callees", none).alias("callees"),
        F.coalesce("notes", none).alias("notes"),
        (F.col("kind").isin(CALLABLE) & F.coalesce("small", F.lit(False))).alias("bundled"),
    )


def gather(index: Index, relations: DataFrame, queries: DataFrame, budget: int = 8000, embed: Embedder | None = None, scorer: scoring.PairScorer = T.hash_score) -> DataFrame:
    """(qid, position, uid, path, phase, cost, spent): the evidence of each request (qid, query) within its budget of tokens."""
    if budget < 1:
        raise ValueError("budget must be positive")
    found = packing.pack_evidence(candidates(index, relations, queries, embed, scorer), budget)
    return found.join(index.units.select("uid", "path"), "uid").select("qid", "position", "uid", "path", "phase", "cost", "spent")


def context(index: Index, found: DataFrame) -> DataFrame:
    """(qid, context): chosen units (qid, position, uid) as numbered lines; what is adjacent stands under one path header.

    Files come in the order of choice. A line that several units have is shown once; none is made up between units.
    """
    rows = found.select("qid", "position", "uid").join(index.units.select("uid", "path", "start", "text"), "uid")
    lines = rows.select("qid", "position", "path", "start", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    last = lines.groupBy("qid", "path", (F.col("start") + F.col("k")).alias("number")).agg(F.max_by("line", "position").alias("line"), F.min("position").alias("position"))
    files = last.groupBy("qid", "path").agg(F.min("position").alias("position"), F.array_sort(F.collect_list(F.struct("number", "line"))).alias("lines"))

    def shown(x: Column, i: Column) -> Column:
        follows = (i > 0) & (F.get("lines", i - 1)["number"] + 1 == x["number"])
        numbered = F.concat(x["number"].cast("string"), F.lit("\t"), x["line"])
        return F.when(F.coalesce(follows, F.lit(False)), numbered).otherwise(F.concat(F.lit("Path: "), F.col("path"), F.lit("\n"), numbered))

    blocks = files.select("qid", "position", F.concat(F.array_join(F.transform("lines", shown), "\n"), F.lit("\n")).alias("block"))
    return blocks.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "block"))), lambda b: b["block"]), "\n").alias("context"))
