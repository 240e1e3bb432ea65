import math
import re
from collections import Counter

import numpy as np
import pytest

from fathomline.llm import perplexity
from fathomline.llm.entry import op9_cross_entropy

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, good):
    docs = [(i, [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORDS.findall(t or "")]) for i, t in rows]
    models = [(Counter(), Counter()), (Counter(), Counter())]
    own = []
    for i, w in docs:
        places = list(zip(["", *w], [*w, ""], strict=True)) if w else []
        own.append((Counter(places), Counter(v for v, _ in places)))
        for k in (0, 1) if i in good else (1,):
            models[k][0].update(own[-1][0])
            models[k][1].update(own[-1][1])
    size = max(1, len(models[1][1]))
    ratio = models[0][1].total() / max(1, models[1][1].total())
    out = []
    for (i, w), (pairs, contexts) in zip(docs, own, strict=True):
        losses = []
        for k, r in ((0, 1.0), (1, ratio)):
            mine = 1 if k or i in good else 0
            loss = 0.0
            for (v, x), n in pairs.items():
                top = r * (models[k][0][v, x] - mine * n) + perplexity.SMOOTHING
                bottom = r * (models[k][1][v] - mine * contexts[v]) + perplexity.SMOOTHING * size
                loss -= n * math.log(top / bottom)
            losses.append(loss / (len(w) + 1) if w else None)
        out.append((i, len(w), *losses))
    return out


@pytest.mark.parametrize(("run_bytes", "bucket_bytes", "sent"), [(8 << 20, 16 << 20, 1 << 22), (400, 100, 1 << 22), (400, 100, 0)])
def test_losses_match_brute_force(spark, monkeypatch, run_bytes, bucket_bytes, sent):
    monkeypatch.setattr(perplexity, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(perplexity, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(perplexity, "SENT_LABELS", sent)
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "γάμμα", "d,", "e", "ALPHA", "f"]
    rows = [(k, " ".join(rng.choice(words, size=int(rng.integers(1, 40))))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (None, "alpha beta"), (5, "another text of id five"), rows[7], (104, "e " * 3000)]
    labels = [(k, int(k % 3 == 0)) for k in range(40)] + [(5, 1), (5, 1), (9, 1), (9, 0), (None, 1), (11, None), (999, 1)]
    good = {k for k in range(0, 40, 3) if k != 9}
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as run", "1 as bucket", "true as good")
    got = perplexity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    key = lambda r: tuple(-1.0 if x is None else round(x, 9) for x in r[:4])
    assert sorted(map(key, got)) == sorted(map(key, brute(rows, good)))


def test_tasks_that_write_take_several_buckets_or_runs(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "RUN_BYTES", 100)
    monkeypatch.setattr(perplexity, "BUCKET_BYTES", 100)
    written = []
    put = perplexity.Workspace.put
    monkeypatch.setattr(perplexity.Workspace, "put", lambda self, df, name: written.append(put(self, df, name)) or written[-1])
    rows = [(k, f"w{k % 7} w{k % 5} w{k % 3} {k}") for k in range(300)] + [(None, None), (7, ""), (900, "w1 " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = perplexity.score(docs, spark.createDataFrame([(k, 1) for k in range(0, 300, 4)], "doc_id long, quality int"))
    n_runs = -(-sum(len(t or "") for _, t in rows) // 100)
    buckets = 1 << math.ceil(math.log2(sum(len(t or "") for _, t in rows) / 100))
    assert written[0].select("bucket").distinct().count() > buckets / 2
    assert len(written[0].inputFiles()) <= -(-buckets // 4)
    assert out.rdd.getNumPartitions() <= -(-n_runs // 4)
    key = lambda r: tuple(-1.0 if x is None else round(x, 9) for x in r[:4])
    assert sorted(map(key, out.collect())) == sorted(map(key, brute(rows, set(range(0, 300, 4)))))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert perplexity.score(docs, labels).count() == 0
    one = perplexity.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), labels).first()
    assert one["score"] == pytest.approx(0.0)


def test_query_matches_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(map(str, con.sql(perplexity.SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in op9_cross_entropy(spark, sf).collect()) == want


def test_target_documents_score_lower(spark):
    rng = np.random.default_rng(8)
    near, far = ["the", "cat", "sat", "on", "mat"], ["zx", "qv", "#", "kk", "jj"]
    rows = [(k, " ".join(rng.choice(near if k % 2 else far, size=30))) for k in range(80)]
    labels = [(k, k % 2) for k in range(40)]
    got = perplexity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).where("doc_id >= 40").collect()
    assert max(r["score"] for r in got if r["doc_id"] % 2) < min(r["score"] for r in got if not r["doc_id"] % 2)
