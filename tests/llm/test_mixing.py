import random
from fractions import Fraction

import pytest

from fathomline.llm import ranking
from fathomline.llm.mixing import MAX_CYCLE, exact_shares, in_mixed_order, mix, schedule, schedule_of_blocks, shares, tempered, with_position


def test_schedule_deviates_by_less_than_a_block():
    rng = random.Random(1)
    for _ in range(30):
        weights = [rng.random() ** 3 + 1e-3 for _ in range(rng.randrange(1, 30))]
        quota = shares(weights, 1000)
        assert sum(quota) == 1000 and min(quota) >= 1
        had = [0] * len(quota)
        for t, (s, i) in enumerate(schedule(quota), 1):
            assert i == had[s]
            had[s] += 1
            assert all(abs(h - Fraction(q * t, 1000)) < 1 for h, q in zip(had, quota, strict=True))


def rows(rng, n):
    return [(i, f"t{i % 9}", rng.choices(["a", "b", "c", None], [70, 15, 10, 5])[0], i) for i in range(n)]


SCHEMA = "doc_id long, text string, source string, position long"


def brute(data, weights, block):
    """Slot by slot over the sources' queues, skipping those at an end."""
    from hashlib import md5

    names = sorted({r[2] for r in data}, key=lambda s: (s is not None, s))
    queues = {s: [r[0] for r in sorted((r for r in data if r[2] == s), key=lambda r: md5(str(r[0]).encode()).hexdigest())] for s in names}
    plan = schedule(shares([weights[s] for s in names], 1000))
    out, done = [], dict.fromkeys(names, 0)
    while len(out) < len(data):
        for s, _ in plan:
            q = queues[names[s]]
            out += q[done[names[s]] : done[names[s]] + block]
            done[names[s]] += block
    return out


def test_positions_match_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 20)
    data = [(i, t, s) for i, t, s, _ in rows(random.Random(2), 900)]
    weights = {"a": 0.4, "b": 0.3, "c": 0.2, None: 0.1}
    got = mix(spark.createDataFrame(data, "doc_id long, text string, source string"), weights, block=4).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == brute(data, weights, 4)
    assert sorted(r.position for r in got) == list(range(len(data)))
    assert all(r.release <= r.slot < r.deadline for r in got)
    had, n = dict.fromkeys(weights, 0), 0
    for r in sorted((r for r in got if r.on_target), key=lambda r: r.position):
        had[r.source] += 1
        n += 1
        assert all(abs(had[s] - weights[s] * n) < 2 * 4 for s in weights)  # a block is being dealt
    assert n > 100


def test_order_on_disk_and_clashing_columns(spark):
    data = rows(random.Random(3), 300) + [(None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    got = in_mixed_order(df)
    assert got.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, data))
    first = [r.source for r in got.collect()][: 4 * 16]
    assert set(first) == {"a", "b", "c", None}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert in_mixed_order(empty).collect() == []
    with pytest.raises(ValueError):
        mix(spark.createDataFrame(rows(random.Random(1), 9), SCHEMA), {"a": 1.0})


def test_exact_shares():
    assert exact_shares([1] * 21) == [1] * 21
    assert exact_shares([0.4, 0.3, 0.2, 0.1]) == [4, 3, 2, 1]
    assert exact_shares([0.0001, 0.9999]) == [1, 9999]
    assert exact_shares([Fraction(1, 3), 2]) == [1, 6]


def held_to_target(spark, n_sources, weights, n, block):
    data = [(i, "t", f"s{i % n_sources:02}" if weights is None else ("a", "b", "c")[min(2, i % 40)]) for i in range(n)]
    got = mix(spark.createDataFrame(data, "doc_id long, text string, source string"), weights, block=block).collect()
    assert sorted(r.position for r in got) == list(range(n))
    assert all(r.release <= r.slot < r.deadline for r in got)
    names = sorted({r.source for r in got})
    exact = {s: Fraction(1, n_sources) if weights is None else Fraction(str(weights[s])) / sum(Fraction(str(w)) for w in weights.values()) for s in names}
    # by slots: one block each; after any number of them every source is within one block of its true weight
    slots = sorted({(r.slot, r.source) for r in got if r.on_target})
    assert [t for t, _ in slots] == list(range(len(slots)))
    had = dict.fromkeys(names, 0)
    for t, s in slots:
        had[s] += 1
        assert all(abs(had[x] - exact[x] * (t + 1)) < 1 for x in names)
    return len(slots)


def test_equal_weights_hold_over_many_cycles(spark):
    for n_sources in (3, 7, 21):
        assert held_to_target(spark, n_sources, None, 6000, 2) > 2900


def test_weights_beyond_a_cycle_hold(spark):
    weights = {"a": 0.0250001, "b": 0.0250003, "c": 0.9499996}
    assert sum(exact_shares(list(weights.values()))) > MAX_CYCLE
    assert held_to_target(spark, 3, weights, 6000, 2) > 2900


def test_schedule_of_blocks_at_its_ends():
    quota = [1, 9999, 20000]
    order, ends = schedule_of_blocks(quota, [3, 2, 7])
    assert sorted((s, i) for s, i, *_ in order) == [(s, i) for s, n in enumerate([3, 2, 7]) for i in range(n)]
    assert all(a[2] < b[2] for a, b in zip(order, order[1:], strict=False))
    assert all(release <= slot < deadline for _, _, slot, release, deadline in order)
    assert 0 < ends <= 8


def test_added_columns_win_over_clashing_ones(spark):
    data = rows(random.Random(7), 60)
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'mine' as slot", "'mine' as _digest", "1 as block")
    got = mix(df)
    assert len(set(got.columns)) == len(got.columns)
    assert {r["_digest"] for r in got.collect()} == {"mine"}
    kept = with_position(df, None, "_mixed")
    assert kept.columns == [*df.columns, "_mixed"]
    assert sorted(r["_mixed"] for r in kept.collect()) == list(range(60)) and {r.slot for r in kept.collect()} == {"mine"}


def test_tempered_weights_hold_by_slots(spark):
    data = [(i, "t", "big" if i % 10 else f"small{i % 3}") for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    weights = tempered(docs)
    assert weights["big"] == 1.0 and all(0.15 < w < 0.25 for s, w in weights.items() if s != "big")
    exact = {s: Fraction(str(w)) / sum(Fraction(str(x)) for x in weights.values()) for s, w in weights.items()}
    had = dict.fromkeys(weights, 0)
    slots = sorted({(r.slot, r.source) for r in mix(docs, weights, block=4).where("on_target").collect()})
    for t, s in slots:
        had[s] += 1
        assert all(abs(had[x] - exact[x] * (t + 1)) < 1 for x in had)
    assert len(slots) > 100


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(rows(random.Random(1), 50), SCHEMA)
    plan = in_mixed_order(docs, tempered(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
