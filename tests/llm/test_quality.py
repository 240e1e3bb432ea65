import collections
import random
from math import comb

from fathomline.llm import quality
from fathomline.llm.quality import assess, chosen_levels, keep_good, upper_bound

SPACE = " \t\n\r\x0b\x0c"


def split(text):
    out, word = [], ""
    for ch in text:
        if ch in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return [*out, word] if word else out


def brute(text):
    text = text or ""
    w = split(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if split(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dups, len(covered)


def texts(rng, n):
    out = []
    for _ in range(n):
        vocab = [rng.choice(["ab", "é", "x|", "#", "Q", "日本"]) + str(rng.randrange(30)) for _ in range(40)]
        out.append("".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t", "  ", " "]) for _ in range(rng.randrange(0, 200))))
    return [*out, None, "", " \n", "a\nb\na\nb\n", "same line\n" * 2000, "x" * 100_000]


def test_counts_match_brute_force(spark):
    data = list(enumerate(texts(random.Random(1), 40)))
    docs = spark.createDataFrame([(i, t, "en") for i, t in data], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in assess(docs, labels).collect()}
    for i, t in data:
        n, chars, symbols, dups, repeats = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats), (i, t)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert r.kept == (not r.base_failed)


def test_bound_is_exact():
    for k, n, delta in [(0, 100, 0.05), (3, 50, 0.01), (20, 400, 0.001), (7, 7, 0.1)]:
        p = upper_bound(k, n, delta)
        cdf = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert p == 1.0 if k == n else abs(cdf - delta) < 1e-9


def test_vectors_are_certified_one_by_one():
    clean, worse = (0,) * 5, (3, 0, 0, 0, 0)
    levels = chosen_levels([("en", {clean: 95_000, worse: 5_000}), ("some", {clean: 350}), ("few", {clean: 100}), ("none", {})])
    assert levels["en"] == {"symbols": 0, "shouting": 8, "dup_lines": 8, "repeats": 8, "long_words": 8}
    assert all(x == 8 for x in levels["some"].values())
    assert not any(levels["few"].values()) and not any(levels["none"].values())


def brute_levels(counts):
    """The same choice written out over single documents, with the bound searched in whole steps of the exact sum."""
    out = {}
    for stratum, docs in counts:
        def sure(vector, error, docs=docs):
            bad = sum(any(0 < v <= x for v, x in zip(vector, d, strict=True)) for d in docs)
            n, p = len(docs), quality.RISK
            return bad < n and sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(bad + 1)) <= error

        along = quality.DELTA / 2 / len(counts)
        diagonal = 0
        for level in range(1, 9):
            if not sure([level] * 5, along):
                break
            diagonal = level
        vector, frozen = [diagonal] * 5, set()
        while len(frozen) < 5:
            for r in range(5):
                if r not in frozen:
                    higher = vector[:r] + [vector[r] + 1] + vector[r + 1 :]
                    if vector[r] < 8 and sure(higher, along / 9**5):
                        vector = higher
                    else:
                        frozen.add(r)
        out[stratum] = dict(zip(quality.RULES, vector, strict=True))
    return out


def test_choice_matches_brute_force():
    rng = random.Random(4)
    for _ in range(6):
        docs = {s: [tuple(rng.choice([0] * 60 + [1, 2, 4, 7]) if rng.random() < 0.03 else 0 for _ in range(5)) for _ in range(n)] for s, n in (("a", 1500), ("b", 400), (None, 90))}
        got = chosen_levels([(s, dict(collections.Counter(d))) for s, d in docs.items()])
        assert got == brute_levels(list(docs.items()))
    assert any(any(x.values()) for x in got.values())


def test_rows_of_one_id_are_one_trial(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "en")] * 400 + [(2, text, "en")], "doc_id long, text string, lang string")
    assert quality.certified(quality.counted(docs, "text", id="doc_id", stratum="lang"), spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")) == {"en": dict.fromkeys(quality.RULES, 0)}


def test_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").selectExpr("*", "7 as n_words", "8 as id", "9 as stratum", "1 as c0", "2 as body", "3 as kept")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert assess(docs, labels).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert assess(docs, labels).first()["n_words"] == 60
    assert keep_good(docs, labels).collect() == docs.collect()


def test_certified_rules_reject_junk_and_keep_good(spark):
    rng = random.Random(2)
    good = lambda: " ".join(f"{rng.choice('abcdefg')}w{rng.randrange(3000)}" for _ in range(60))
    data = [(i, good(), "en" if i % 3 else None) for i in range(2400)]
    junk = [(10_000 + i, " ".join(f"w{rng.randrange(10**6)}$$$" for _ in range(60)), "en") for i in range(40)]
    other = [(20_000, " ".join(f"w{rng.randrange(10**6)}$$$" for _ in range(60)), "xx")]
    docs = spark.createDataFrame(data + junk + other, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in data] + [(i, 0) for i, _, _ in junk] + [(None, 1), (5, None), (99_999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in assess(docs, labels).collect()}
    assert all(got[i] for i, _, _ in data)
    assert not any(got[i] for i, _, _ in junk)
    assert got[20_000], "a stratum without labels loses nothing to the rules"
    assert {r.doc_id for r in keep_good(docs, labels).collect()} == {i for i, k in got.items() if k}
    assert keep_good(docs, labels).columns == docs.columns


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int")
    assert assess(docs, labels).collect() == [] == keep_good(docs, labels).collect()
