"""Typed edges between units: adjacency, expansion, support, closure and reference resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut

HUB = 24


def reverse(edges: DataFrame) -> DataFrame:
    """(dst, sources): who points at a unit, sorted."""
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("sources"))


#: pairs that one task groups at once
PAIRS = 1 << 19


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): both directions with the largest confidence.

    A pair is grouped once for both directions, and dealt out by the number of edges, so what a task holds does not grow with them.
    """
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "confidence")
    best = pair.repartition(max(1, -(-edges.count() // PAIRS)), "a", "b").groupBy("a", "b").agg(F.max("confidence").alias("weight"))
    return best.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))))


def around(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, weight): what ``undirected`` has for the stated units (uid) as ``src``; other edges are left before anything is grouped."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence")
    both = edges.select("src", "dst", "confidence").unionByName(back).where("src <> dst")
    return both.join(units.select(F.col("uid").alias("src")), "src", "left_semi").groupBy("src", "dst").agg(F.max("confidence").alias("weight"))


def one_hop(seeds: DataFrame, links: DataFrame, fused: DataFrame, keep: int = 10) -> DataFrame:
    """(uid, prior): up to ``keep`` neighbours of each seed by fused score; prior is half the best seed's score."""
    met = seeds.select(F.col("uid").alias("src"), F.col("score").alias("seed")).join(links, "src").join(fused.select(F.col("uid").alias("dst"), "score"), "dst")
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return met.withColumn("k", place).where(F.col("k") <= keep).groupBy(F.col("dst").alias("uid")).agg(F.round(F.max(F.col("seed") * 0.5), 9).alias("prior"))


def support(core: DataFrame, links: DataFrame) -> DataFrame:
    """(uid, support) of units outside the core: the best score times confidence over the number of new neighbours."""
    new = links.join(core.select(F.col("uid").alias("dst")), "dst", "left_anti").join(core.select(F.col("uid").alias("src"), "score"), "src")
    shared = new.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("src")))
    return shared.groupBy(F.col("dst").alias("uid")).agg(F.round(F.max(F.col("score") * F.col("weight") / F.col("n")), 9).alias("support"))


def hub_guard(seeds: DataFrame, edges: DataFrame, cap: int = 80) -> DataFrame:
    """(uid, support): neighbours of the seeds; of a seed with over ``HUB`` neighbours only those it points at."""
    out = edges.select("src", "dst", "confidence").withColumn("forward", F.lit(1))
    both = out.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence").withColumn("forward", F.lit(0)))
    links = both.groupBy("src", "dst").agg(F.max("forward").alias("forward"), F.max("confidence").alias("confidence"))
    met = links.join(seeds.select(F.col("uid").alias("src")), "src", "left_semi").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("src")))
    open_ = met.where((F.col("n") <= HUB) | (F.col("forward") == 1)).join(seeds.select(F.col("uid").alias("dst")), "dst", "left_anti")
    found = open_.groupBy(F.col("dst").alias("uid")).agg(F.round(F.max(F.col("confidence") / F.col("n")), 9).alias("support"))
    return found.orderBy(F.desc("support"), "uid").limit(cap)


def two_hop(anchors: DataFrame, edges: DataFrame, floor: float = 0.05, keep: int = 16, hops: int = 2) -> DataFrame:
    """(uid, score): best score over paths of up to two links of ``undirected`` edges; weak frontiers stop.

    Only the links around a frontier are made and ranked.
    """
    frontier = anchors.select("uid", "score")
    reached = frontier
    for _ in range(hops):
        ahead = frontier.where(F.col("score") > floor)
        best = around(edges, ahead).withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))).where(F.col("k") <= keep)
        step = ahead.select(F.col("uid").alias("src"), F.col("score").alias("had")).join(best, "src")
        frontier = step.groupBy(F.col("dst").alias("uid")).agg(F.round(F.max(F.col("had") * F.col("weight")), 9).alias("score"))
        reached = reached.unionByName(frontier)
    return reached.groupBy("uid").agg(F.max("score").alias("score"))


def owner_closure(units: DataFrame) -> DataFrame:
    """(symbol, root): climb ``owner`` while the ancestor is callable, to the last one; symbols are distinct.

    Pointers are doubled, so a chain of n owners takes log2(n) joins. Owners that go round in a
    circle never end that way; only those are climbed step by step, up to the symbol before the first repeated one.
    """
    ups = cut(units.join(units.where("callable").select(F.col("symbol").alias("owner"), F.lit(True).alias("there")), "owner", "left").select("symbol", F.when(F.col("there"), F.col("owner")).otherwise(F.col("symbol")).alias("root")))
    now, rounds = ups, max(1, ups.count()).bit_length() + 1
    while True:
        far = now.select(F.col("symbol").alias("root"), F.col("root").alias("far"))
        after = cut(now.join(far, "root").select("symbol", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        moved = after.where("moved").count()
        now, rounds = after.select("symbol", "root"), rounds - 1
        if not moved:
            return now
        if not rounds:
            break
    tops = ups.where("symbol = root").select("root")
    done = now.join(tops, "root", "left_semi").select("symbol", "root")
    walk = now.join(tops, "root", "left_anti").select("symbol", F.col("symbol").alias("at"), F.array("symbol").alias("seen"))
    found = None
    step = ups.select(F.col("symbol").alias("at"), F.col("root").alias("next"))
    while True:
        ahead = cut(walk.join(step, "at").withColumn("again", F.array_contains("seen", F.col("next"))))
        ended = ahead.where("again").select("symbol", F.col("at").alias("root"))
        found = ended if found is None else found.unionByName(ended)
        walk = ahead.where("not again").select("symbol", F.col("next").alias("at"), F.concat("seen", F.array("next")).alias("seen"))
        if walk.isEmpty():
            return done.unionByName(found)


def bundles(units: DataFrame, calls: DataFrame, small: int = 256, total: int = 768, hops: int = 2, most_callers: int = 4) -> DataFrame:
    """(uid, bundle): the units that are given with a unit, in order of their ids.

    ``units`` are (uid, symbol, owner, kind, cost), ``calls`` (src, dst) between uids. Units of one
    outermost callable are a family; a family of at most ``small`` tokens takes its callers' families
    along, up to ``hops`` steps away and ``total`` tokens, unless a family has over ``most_callers``
    callers. A caller's families are at most ``most_callers ** hops``, so each root is settled by itself.
    """
    heads = units.groupBy("symbol").agg(F.min_by(F.struct("owner", "kind"), "uid").alias("x")).select("symbol", "x.owner", F.col("x.kind").isin("function", "method").alias("callable"))
    roots = owner_closure(heads)
    placed = cut(units.join(roots, "symbol").select("uid", "root", "cost"))
    family = placed.groupBy("root").agg(F.array_sort(F.collect_list("uid")).alias("uids"), F.sum("cost").alias("cost"))
    callable_roots = heads.where("callable").select(F.col("symbol").alias("root"))
    little = cut(family.where(F.col("cost") <= small).join(callable_roots, "root", "left_semi"))
    lifted = calls.join(placed.select(F.col("uid").alias("src"), F.col("root").alias("caller")), "src").join(placed.select(F.col("uid").alias("dst"), F.col("root").alias("called")), "dst").where("caller <> called").select("caller", "called").distinct()
    few = lifted.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("called"))).where(F.col("n") <= most_callers).select("caller", "called")
    first = family.select(F.col("root").alias("caller"), F.get("uids", F.lit(0)).alias("first"))
    step = cut(few.join(little.select(F.col("root").alias("caller"), "cost"), "caller").join(first, "caller").select("called", F.struct(F.col("first"), F.col("caller").alias("root"), F.col("cost")).alias("c")).groupBy("called").agg(F.array_sort(F.collect_list("c")).alias("callers")))
    kind = "array<struct<root:string,cost:bigint>>"
    state = little.select("root", F.array(F.struct("root", F.col("cost").cast("long").alias("cost"))).cast(kind).alias("held"), F.array("root").alias("frontier"))
    for _ in range(hops):
        ahead = state.select("root", "held", F.posexplode_outer("frontier").alias("k", "called")).join(step, "called", "left")
        offered = ahead.groupBy("root").agg(F.first("held").alias("held"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("callers", F.array().cast("array<struct<first:bigint,root:string,cost:bigint>>")).alias("callers")))), lambda x: x["callers"])).alias("offer"))

        def take(held, offer):
            fits = (F.aggregate(held, F.lit(0).cast("long"), lambda s, x: s + x["cost"]) + offer["cost"] <= total) & ~F.exists(held, lambda x: x["root"] == offer["root"])
            return F.when(fits, F.concat(held, F.array(F.struct(offer["root"].alias("root"), offer["cost"].alias("cost"))).cast(kind))).otherwise(held)

        after = offered.withColumn("all", F.aggregate("offer", F.col("held"), take))
        state = cut(after.select("root", F.col("all").alias("held"), F.transform(F.slice("all", F.size("held") + 1, F.greatest(F.lit(1), F.size("all"))), lambda x: x["root"]).alias("frontier")))
    uids = state.select("root", F.explode("held").alias("h")).select("root", F.col("h.root").alias("part")).join(little.select(F.col("root").alias("part"), "uids"), "part")
    whole = uids.groupBy("root").agg(F.array_sort(F.flatten(F.collect_list("uids"))).alias("bundle"))
    return placed.join(whole, "root", "left").select("uid", F.coalesce("bundle", F.array("uid")).alias("bundle"))


def qualified(names: DataFrame, modules: DataFrame) -> DataFrame:
    """(name, module, rest) of dotted names by the longest module prefix.

    A prefix is a module of exactly this name or the only module with this dotted suffix; a longer
    prefix that several modules share leaves the name unresolved.
    """
    parts, suffix = F.split("name", r"\."), F.split("module", r"\.")
    cuts = names.select("name").distinct().select("name", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1))).alias("k")).where(F.size(parts) > F.col("k"))
    cuts = cuts.select("name", "k", F.array_join(F.slice(parts, 1, F.col("k")), ".").alias("prefix"), F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), ".").alias("rest"))
    tails = modules.select("module").distinct().select("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(suffix)), lambda i: F.array_join(F.slice(suffix, i, F.size(suffix)), "."))).alias("prefix"))
    known = tails.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("module").alias("only"), F.max(F.col("module") == F.col("prefix")).alias("exact"))
    met = cuts.join(known, "prefix")
    best = met.groupBy("name").agg(F.max_by(F.struct("prefix", "rest", "n", "only", "exact"), "k").alias("x"))
    return best.where("x.exact or x.n = 1").select("name", F.when(F.col("x.exact"), F.col("x.prefix")).otherwise(F.col("x.only")).alias("module"), "x.rest")


def family_completion(units: DataFrame, chosen: DataFrame, limit: int = 3200) -> DataFrame:
    """(family, uid) of the parts that complete the families (family, uid, cost) of the chosen units, where the whole fits."""
    whole = units.groupBy("family").agg(F.sum("cost").alias("total")).where(F.col("total") <= limit).select("family")
    asked = units.join(chosen.select("uid"), "uid", "left_semi").select("family").distinct()
    return units.join(whole.join(asked, "family"), "family", "left_semi").join(chosen.select("uid"), "uid", "left_anti").select("family", "uid")


def corroboration(calls: DataFrame, scores: DataFrame, most: int = 8) -> DataFrame:
    """(uid, support): the best score of a caller (uid, score) over the root of its number of callees (src, dst), for callers of at most ``most``."""
    fan = calls.select("src", "dst").distinct().withColumn("n", F.count(F.lit(1)).over(W.partitionBy("src"))).where(F.col("n") <= most)
    met = fan.join(scores.select(F.col("uid").alias("src"), "score"), "src")
    return met.groupBy(F.col("dst").alias("uid")).agg(F.max(F.col("score") / F.sqrt("n")).alias("support"))


#: what each kind of relation lends an entity link, forwards and backwards
LINK_WEIGHTS = {"calls": 0.85, "member_of": 0.7, "references_type": 0.6, "imports": 0.4}


def entity_links(relations: DataFrame, owners: DataFrame, weights: dict[str, float] = LINK_WEIGHTS) -> DataFrame:
    """(src, dst, weight, n) between entities: relations (src, dst, kind, confidence) of units lifted to owners (uid, entity), both ways, the best of each pair."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    one = relations.select("src", "dst", (F.col("confidence") * F.coalesce(F.try_element_at(known, "kind"), F.lit(0.0))).alias("w")).where("w > 0")
    lifted = one.join(owners.select(F.col("uid").alias("src"), F.col("entity").alias("a")), "src").join(owners.select(F.col("uid").alias("dst"), F.col("entity").alias("b")), "dst").where("a <> b")
    both = lifted.select("a", "b", "w").unionByName(lifted.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.max("w").alias("weight"), F.count(F.lit(1)).alias("n"))


def resolve(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, symbol): the only symbol whose dotted suffix is the name; ambiguous names resolve to nothing."""
    parts = F.split("symbol", r"\.")
    suffixes = symbols.select("symbol", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("name"))
    only = suffixes.groupBy("name").agg(F.min("symbol").alias("symbol"), F.max("symbol").alias("other")).where("symbol = other").drop("other")
    return names.select("name").distinct().join(only, "name")


def within(links: DataFrame, spans: DataFrame) -> DataFrame:
    """Links (module, line, target) met with the unit span (module, start, end, uid) that holds the line.

    Spans are cut into stretches of 64 lines, so the range condition becomes an equi-join with a filter.
    """
    cell = 64
    cut = spans.select("*", F.explode(F.sequence((F.col("start") / cell).cast("int"), (F.col("end") / cell).cast("int"))).alias("cell"))
    return links.withColumn("cell", (F.col("line") / cell).cast("int")).join(cut, ["module", "cell"]).where("line between start and end").drop("cell")
