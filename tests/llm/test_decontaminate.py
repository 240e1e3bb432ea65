import random

import numpy as np

from fathomline.llm import decontaminate
from fathomline.llm.decontaminate import contaminated, without_contaminated


def words(text):
    return (text or "").encode().lower().split()


def brute(docs, items):
    """Every diagonal of every pair, without seeds."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            best = 0
            for shift in range(-len(v) + 1, len(w)):
                pairs = [w[shift + k] == v[k] for k in range(len(v)) if 0 <= shift + k < len(w)]
                top = low = at = 0
                stretch = (0, 0)
                total = 0
                for k, same in enumerate(pairs):
                    total += 1 if same else -3
                    if total < low:
                        low, at = total, k + 1
                    if total - low > top:
                        top, stretch = total - low, (at, k + 1)
                agree = sum(pairs[stretch[0] : stretch[1]])
                if agree and agree >= min(13, len(v)) and 100 * agree >= 80 * (stretch[1] - stretch[0]):
                    best = max(best, agree)
            if best:
                out[d, i] = best
    return out


def run(spark, docs, items):
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.n_match for r in got.collect()}


def test_matches_brute_force(spark):
    rng = random.Random(4)
    pick = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    items = [(k, " ".join(pick(rng.choice([3, 8, 16, 30, 50])))) for k in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        body = pick(rng.randrange(0, 60))
        if rng.random() < 0.6:
            item = words(rng.choice(items[:12])[1])
            item = [x.decode() for x in item]
            a = rng.randrange(0, 1 + len(item) // 3)
            item = item[a:]
            for _ in range(rng.randrange(0, 1 + len(item) // 12)):
                item[rng.randrange(len(item))] = "other"
            at = rng.randrange(len(body) + 1)
            body = body[:at] + [x.upper() for x in item] + body[at:]
        docs.append((d, "\n".join(body)))
    docs += [(100, None), (101, ""), (102, "x" * 50_000)]
    want = brute(docs, items)
    assert len(want) > 10
    assert run(spark, docs, items) == want


def test_a_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    items = [(k, " ".join(f"a{k}b{j}" for j in range(20))) for k in range(9)]
    docs = [(k, f"before {t} after") for k, t in items] + [(50, "clean text of some words")]
    whole = run(spark, docs, items)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    assert run(spark, docs, items) == whole == {(k, k): 20 for k in range(9)}
    frame = spark.createDataFrame([*docs, (50, "clean text of some words"), (60, None)], "doc_id long, text string").selectExpr("*", "1 as h1", "2 as body")
    kept = without_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [50, 50, 60]


def test_other_columns_may_clash(spark):
    text = " ".join(f"t{j}" for j in range(20))
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string").selectExpr("*", "5 as body", "6 as item_id", "7 as n_words")
    assert [tuple(r) for r in contaminated(docs, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()] == [(1, 7, 0, 0, 20, 20)]


def test_filter_keeps_columns_and_clean_rows(spark):
    item = " ".join(f"t{j}" for j in range(20))
    docs = spark.createDataFrame([(1, item, "a", 5), (1, "clean", "b", 6), (None, None, None, None)], "doc_id long, text string, body string, c0 int")
    got = without_contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["(1, 'clean', 'b', 6)", "(None, None, None, None)"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = [(1, "a b c")]
    assert contaminated(*none).collect() == []
    assert run(spark, some, []) == {}
    assert run(spark, [], some) == {}


def all_stretches(same, need):
    """The most agreeing words in any stretch that meets both limits."""
    best = 0
    for a in range(len(same)):
        for b in range(a + 1, len(same) + 1):
            agree = sum(same[a:b])
            if agree >= need and 100 * agree >= 80 * (b - a):
                best = max(best, agree)
    return best


def test_any_stretch_on_the_diagonal_counts(spark):
    rng = random.Random(11)
    docs, items, want, lost = [], [], set(), 0
    for k in range(250):
        size = rng.choice([14, 16, 18, 20, 25, 30])
        item = [f"i{k}w{j}" for j in range(size)]
        same = [True] * size
        for j in rng.sample(range(size), rng.randrange(0, size // 3)):
            same[j] = False
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(["before", *(w if s else "other" for w, s in zip(item, same, strict=True)), "after"])))
        seeded = any(all(same[p + j] for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(size - len(m) + 1))
        start, stop = decontaminate._best_stretch(np.array(same))
        if seeded and all_stretches(same, 13):
            want.add((k, k))
            lost += not (sum(same[start:stop]) >= 13 and 100 * sum(same[start:stop]) >= 80 * (stop - start))
    got = run(spark, docs, items)
    assert set(got) == want
    assert lost > 20
    clean = without_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_widest_stretch_against_all():
    rng = random.Random(12)
    for _ in range(400):
        same = [rng.random() < rng.choice([0.6, 0.8, 0.9]) for _ in range(rng.randrange(1, 40))]
        if not any(same):
            continue
        start, stop = decontaminate._widest_stretch(np.array(same))
        assert same[start] and same[stop - 1]
        assert sum(same[start:stop]) == all_stretches(same, 1)
        assert 100 * sum(same[start:stop]) >= 80 * (stop - start)
