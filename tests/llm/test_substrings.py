import hashlib
import random

from fathomline.llm import substrings
from fathomline.llm.substrings import digest, maximal_repeats, remove_repeats


def brute(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in digest(remove_repeats(df)).collect())


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 60))))
            if rng.random() < 0.2 and parts[-1]:
                k = rng.randrange(len(parts[-1]))
                parts[-1] = parts[-1][:k] + "#" + parts[-1][k + 1 :]
        rows.append((i, " ".join(parts)))
    return rows


def test_matches_brute_force(spark):
    rng = random.Random(11)
    rows = corpus(rng, 120)
    rows += [(1000, "the " * 200), (1001, "a" * 500), (1002, "the " * 90), (1003, None), (1004, ""), (1005, "b" * 99), (1006, "b" * 100), (1007, "b" * 101), (1008, rows[5][1]), (1009, "xyz" * 20_000)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_crowded_buckets_give_the_same(spark, monkeypatch):
    rng = random.Random(12)
    rows = corpus(rng, 60)
    monkeypatch.setattr(substrings, "BUCKET_CLASSES", 1)
    assert run(spark, rows) == brute(rows)


def test_rows_of_one_id_and_null_ids(spark):
    text = "".join(random.Random(1).choices("abc ", k=300))
    got = run(spark, [(1, text), (1, text), (2, text)])
    assert [r[2] for r in got] == [0, 0, 300]
    assert sorted(r.n_removed for r in digest(remove_repeats(spark.createDataFrame([(None, text), (7, text)], "doc_id long, text string"))).collect()) == [0, 300]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_groups_have_all_occurrences():
    rng = random.Random(2)
    core = bytes(rng.randrange(97, 123) for _ in range(130))
    texts = [b"1" + core + b"x", b"2" + core + b"y", b"3" + core + b"x"]
    groups, gone = maximal_repeats(texts, [(k, 0) for k in range(3)])
    assert (130, [0, 1, 2]) in [(n, sorted(f for f, _ in where)) for n, where in groups]
    assert (131, [0, 2]) in [(n, sorted(f for f, _ in where)) for n, where in groups]
    assert sorted(gone) == [(1, 1, 130), (2, 1, 131)]


def test_spans_and_kept_bytes_make_the_text_again(spark):
    rng = random.Random(13)
    rows = [(i, text, i, [i]) for i, text in corpus(rng, 60)] + [(900, None, 1, None), (901, "", 2, [])]
    rows += [(902, rows[3][1], 3, [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, spans array<int>")
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert set(got) == {r[0] for r in rows} and any(r.spans for r in got.values())
    for i, text, _, _ in rows:
        raw, r = (text or "").encode(), got[i]
        ends = [0, *(x for s in r.spans for x in (s.start, s.stop)), len(raw)]
        assert ends == sorted(ends) and all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))
        assert bytes(r.kept) == b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
        assert r.n_bytes == len(raw) == len(r.kept) + sum(s.stop - s.start for s in r.spans)
