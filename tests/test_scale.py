"""Steps that must not shuffle, sort or hold more than follows the input; each against a plain version."""

import random
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.functions.words import words
from fathomline.operators import graph, recall
from fathomline.plans import code
from fathomline.sources import shared


def shuffled(df):
    """Rows written by the exchanges of the plan that ran last for ``df``."""
    plan, found, open_ = df._jdf.queryExecution().executedPlan(), 0, []
    open_.append(plan)
    while open_:
        node = open_.pop()
        if node.nodeName() == "Exchange":
            found += node.metrics().apply("shuffleRecordsWritten").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            open_.append(node.plan())
        else:
            open_ += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_affinities_of_all_pairs_shuffle_no_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in v / np.linalg.norm(v)], None if k % 7 == 6 else k % 3) for k, v in enumerate(rng.normal(size=(600, 8)))]
    vectors = spark.createDataFrame(rows, "uid long, vec array<double>, col int").repartition(5)
    vectors.count()
    queries = spark.createDataFrame([(1000 + k, rows[k][1]) for k in range(50)], "qid long, vec array<double>")
    near = recall.dense_affinity(vectors, queries)
    got = {(r["qid"], r["uid"]): (r["col"], r["affinity"]) for r in near.collect()}
    scores = np.round(np.array([r[1] for r in rows]) @ np.array([r[1] for r in rows[:50]]).T, 9)
    best = {c: scores[[k for k, r in enumerate(rows) if r[2] == c]].max(axis=0) for c in (0, 1, 2, None)}
    assert len(got) == 30_000
    assert all(got[1000 + q, u][0] == rows[u][2] and abs(got[1000 + q, u][1] - np.exp((scores[u, q] - best[rows[u][2]][q]) / 0.06)) < 1e-6 for q in range(50) for u in range(600))
    # what tasks found best of a query and a column, and the vectors dealt out above; not the 30,000 pairs
    assert shuffled(near) <= 2 * 600 + 5 * 4 * 50


ODD = ["", "a", "ab", "1a", "12ab3c", "aB cDeF XMLHttp", "snake_case_x9", "İstanbul Iİa 5Kelvin K", "ñandú Ñu éa1", "x" * 40, "0123 9z9", "a\nbc\tde-f", "日本ab語cd", "ßẞa ﬀx ﬃ", "aAbBcC Zz9Zz", None]


def test_words_are_the_terms_of_texts(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abAB01_ -\nİKñé日") for _ in range(rng.randrange(60))) for _ in range(400)]
    want = [r[0] or [] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").orderBy("k").select(T.terms(F.col("text"))).collect()]
    array = pa.concat_arrays([pa.array(["before it"]), pa.array(texts), pa.array(["xy"])]).slice(1, len(texts))
    rows, terms = words(array)
    got = [[] for _ in texts]
    for k, t in zip(rows, terms.to_pylist(), strict=True):
        got[k].append(t)
    assert got == want


def _corpus(spark, n=500):
    rng = random.Random(7)
    vocabulary = [f"w{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    units = [(k, " ".join(rng.choices(vocabulary, weights=range(1, 65), k=rng.randrange(30))) if k % 50 else None, "fr" if k % 3 else "en") for k in range(n)]
    asked = [(k, " ".join(rng.choices(vocabulary, k=6))) for k in range(30)] + [(90, "nothing here"), (91, None)]
    return spark.createDataFrame(units, "uid long, text string, lang string").repartition(5), spark.createDataFrame(asked, "qid long, query string")


def test_lexical_tops_are_the_best_of_all_scores_and_shuffle_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(recall, "CELLS", 900)
    monkeypatch.setattr(recall, "BLOCK_QUERIES", 20)
    units, queries = _corpus(spark)
    postings, lengths = recall.postings(units, F.col("text")), recall.lengths(units, F.col("text"))
    scores = recall.bm25(postings, lengths, queries).collect()
    french = {r["uid"] for r in units.where("lang = 'fr'").collect()}
    for source, within in ((recall.Texts(units, F.col("text")), F.col("lang") == "fr"), (recall.Counts(postings, lengths), units.where("lang = 'fr'"))):
        lanes = recall.lexical_tops(source, queries, [(7, None), (12, within)])
        for (k, keep), lane in zip(((7, None), (12, french)), lanes, strict=True):
            by_query = defaultdict(list)
            for r in scores:
                if r["score"] > 0 and (keep is None or r["uid"] in keep):
                    by_query[r["qid"]].append((-r["score"], r["uid"]))
            want = {(q, u): (-s, place) for q, rows in by_query.items() for place, (s, u) in enumerate(sorted(rows)[:k])}
            got = {(r["qid"], r["uid"]): (r["score"], r["rank"]) for r in lane.collect()}
            assert got.keys() == want.keys() and all(abs(got[x][0] - want[x][0]) < 1e-8 and got[x][1] == want[x][1] for x in want)
            if isinstance(source, recall.Texts):
                # at most k for each query and task, and the units dealt out above; all pairs that meet are over 9,000
                assert len(scores) > 9_000 and shuffled(lane) <= 2 * 500 + 5 * 30 * k


def test_text_vectors_are_the_hashed_vectors(spark):
    units, _ = _corpus(spark, 120)
    want = {r["uid"]: r["vec"] for r in recall.hashed_vectors(recall.postings(units, F.col("text"))).collect()}
    found = recall.text_vectors(units, F.col("text"))
    assert {r["uid"]: r["vec"] for r in found.collect()} == want and shuffled(found) <= 120


def _edges(spark, n=4000):
    rng = random.Random(11)
    return [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 8) / 10) for _ in range(n)]


def test_links_are_grouped_once_in_tasks_that_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 500)
    rows = _edges(spark) + [(None, 1, 0.5), (1, None, 0.5)]
    best = defaultdict(float)
    for a, b, c in rows:
        if None not in (a, b) and a != b:
            best[a, b], best[b, a] = max(best[a, b], c), max(best[b, a], c)
    links = graph.undirected(spark.createDataFrame(rows, "src long, dst long, confidence double"))
    assert {(r["src"], r["dst"]): r["weight"] for r in links.collect()} == best and links.count() == len(best)
    # one exchange of the edges, dealt to a task for each 500
    assert shuffled(links) <= len(rows) and links.rdd.getNumPartitions() == 9


def test_steps_around_few_units_group_their_links_only(spark):
    rows = _edges(spark)
    edges = spark.createDataFrame(rows, "src long, dst long, confidence double")
    core = spark.createDataFrame([(3, 0.9), (8, 0.5)], "uid long, score double")
    near = graph.around(edges, F.broadcast(core))
    whole = {(r["src"], r["dst"]): r["weight"] for r in graph.undirected(edges).collect()}
    assert {(r["src"], r["dst"]): r["weight"] for r in near.collect()} == {k: v for k, v in whole.items() if k[0] in (3, 8)}
    assert shuffled(near) <= 2 * 2 * 60 * 4
    want = {3: 0.9, 8: 0.5}
    frontier = dict(want)
    for _ in range(2):
        found = defaultdict(float)
        for u, had in frontier.items():
            for w, v in sorted((-w, b) for (a, b), w in whole.items() if a == u)[:16]:
                found[v] = max(found[v], round(had * -w, 9))
        frontier = {u: x for u, x in found.items() if x > 0.05}
        for u, x in found.items():
            want[u] = max(want.get(u, 0), x)
    assert {r["uid"]: r["score"] for r in graph.two_hop(core, edges).collect()} == want


def test_postings_are_counted_where_texts_stand(spark):
    units, _ = _corpus(spark, 200)
    found = recall.text_postings(units, F.col("text"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in recall.postings(units, F.col("text")).collect()}
    assert shuffled(found) <= 200


def test_search_meets_a_common_term_by_units_not_by_pairs(spark):
    units = spark.createDataFrame([(k, f"same word u{k}") for k in range(300)], "uid long, text string").coalesce(2)
    queries = spark.createDataFrame([(k, f"the same u{k}") for k in range(40)], "qid long, query string")
    postings, lengths = recall.postings(units, F.col("text")), recall.lengths(units, F.col("text"))
    rows = postings.count()
    (found,) = recall.lexical_tops(recall.Counts(postings, lengths), queries, [(3, None)])
    assert [(r["qid"], r["uid"]) for r in found.where("rank = 0").orderBy("qid").collect()] == [(k, k) for k in range(40)]
    found.collect()
    # the postings are made and met by unit, then 3 of each query and task; the pairs that share the term are 12,000
    assert shuffled(found) <= 2 * rows + 300 + 4 * 40 * 3


def test_files_of_a_nation_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(shared, "READ", 10)
    supplier = spark.createDataFrame([(k, 1) for k in range(95)], "s_suppkey long, s_nationkey int")
    files = code._files(SimpleNamespace(supplier=supplier), ".py", "python", F.lit("x = 1"))
    assert files.rdd.getNumPartitions() == 10 and files.select("path").distinct().count() == 95
