import random

from fathomline.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, family string, rep long"


def brute(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        if len(words) >= 5:
            sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
        else:
            sets.append({tuple(words)} if words else set())
    ids = [i for i, _ in rows]
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), True if i is None else find(i) == i) for i, s in zip(ids, sets, strict=True)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def test_families_match_brute_force(spark):
    rng = random.Random(3)
    rows, k = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 300))]
        for e in range(rng.randrange(1, 14)):
            rows.append((k, " ".join(edited(rng, base, rng.randrange(0, 1 + e)))))
            k += 1
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE Two"), (6, "two one"), (None, "one two"), (7, "a b c d e"), (8, "A B C D E"), (8, "one two"), (9, "x" * 200_000), (10, "é " * 5000), (11, "é " * 6000), (12, None)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_blocks_of_a_large_family(spark, monkeypatch):
    """A family over several blocks gives the same components as one block."""
    import numpy as np

    from fathomline.llm import minhash
    from fathomline.llm.kernels import Words, shingle_sets, text_buffer
    import pyarrow as pa

    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = [" ".join(edited(rng, base, rng.randrange(0, 6))) for _ in range(90)]
    data, off = text_buffer(pa.array(texts))
    sets = shingle_sets(Words(data, off, 0, len(texts), True), 5)
    ids = np.arange(len(texts))

    def parts(links):
        root = list(range(len(texts)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(texts))]

    whole = parts(minhash.confirmed_links(ids, sets))
    split = []
    for bi in range(3):
        for bj in range(bi, 3):
            pick = [i for i in ids if i % 3 in (bi, bj)]
            left = np.array([i % 3 == bi for i in pick]) if bi != bj else None
            split += minhash.confirmed_links(np.array(pick), [sets[i] for i in pick], left)
    assert parts(split) == whole


def test_large_families_match_brute_force(spark, monkeypatch):
    """Small blocks cut every family, a chain and ids of several texts among them."""
    from fathomline.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_DOCS", 6)
    rng = random.Random(11)
    rows, k = [], 0
    for edits in (1, 5, 12):
        base = [f"w{rng.randrange(500)}" for _ in range(200)]
        for _ in range(50):
            rows.append((k, " ".join(edited(rng, base, rng.randrange(0, 1 + edits)))))
            k += 1
    # a chain in which each text is near to the next only, and two ids of several texts
    words = [f"w{rng.randrange(500)}" for _ in range(200)]
    for _ in range(30):
        words = edited(rng, words, 2)
        rows.append((k, " ".join(words)))
        k += 1
    rows += [(3, rows[60][1]), (101, "some other text of its own"), (None, rows[0][1])]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)

