"""The pipeline against a brute-force version of each stage."""

import re
import shutil
from collections import Counter

import pandas as pd
import pytest

import corpus_pipeline
from fathomline.llm import quality

from .test_quality import brute_levels

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables with odd rows added."""
    out = tmp_path_factory.mktemp("tables")
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    clean = docs[docs.text.str.len().between(1500, 6000)].iloc[0]
    odd = [(9001, None, "en", "src1"), (9002, "", "en", None), (9003, "too few words", None, "src1"), (9004, clean.text, clean.lang, None), (9004, clean.text, clean.lang, None), (9005, clean.text + " " + bench.text[0] + " " + "tail " * 3, clean.lang, "src2")]
    extra = pd.DataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in odd], columns=docs.columns)
    pd.concat([docs, extra]).to_parquet(out / "documents.parquet", index=False)
    bench.to_parquet(out / "benchmark.parquet", index=False)
    shutil.copy(f"{SF}/labels.parquet", out / "labels.parquet")
    return str(out)


def fold(text):
    return WORDS.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def base_ok(text):
    w = WORDS.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w) >= 50 and 100 * len(hit) <= 50 * len(w)


def figures(text):
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    letters = re.findall("[A-Za-z]", text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return {"symbols": (len(re.findall(r"[#*$%&|<>]", text)), len(w)), "shouting": (sum(c.isupper() for c in letters), len(letters)), "dup_lines": (len(lines) - len(set(lines)), len(lines)), "repeats": (len(hit), len(w)), "long_words": (sum(map(len, w)), len(w))}


def reached(text, rule, cutoff):
    over, under = figures(text)[rule]
    return under > 0 and over >= cutoff * under


def brute_quality(docs, labels):
    good = {i for i, q in labels.groupby("doc_id").quality.min().items() if q == 1}
    strata = sorted(docs.lang.fillna("?").unique())
    cuts = {rule: c for rule, (_, c) in quality.RULES.items()}
    counts = []
    for s in strata:
        held = {}
        for i, t, lang in zip(docs.doc_id, docs.text, docs.lang.fillna("?"), strict=True):
            if lang == s and i in good and base_ok(t):
                levels = tuple(sum(reached(t, rule, x) for x in c) for rule, c in cuts.items())
                held[i] = tuple(map(max, held.get(i, levels), levels))
        counts.append((s, list(held.values())))
    levels = brute_levels(counts)
    kept = [base_ok(t) and not any(reached(t, rule, cuts[rule][n - 1]) for rule, n in levels[s].items() if n) for t, s in zip(docs.text, docs.lang.fillna("?"), strict=True)]
    return docs[kept]


def brute_near(docs):
    sets = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = fold(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = len(sets[a]), len(sets[b])
            if x and y and 100 * min(x, y) >= 85 * max(x, y):
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (x + y - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return docs[[find(i) == i for i in docs.doc_id]]


def brute_clean(docs, bench):
    items = [fold(t) for t in bench.text]
    masks = ("11101001011", "11001101101", "10110110011", "11011010101")
    seeds = {}
    for k, w in enumerate(items):
        for m in masks:
            for p in range(len(w) - len(m) + 1):
                seeds.setdefault((m, tuple(w[p + j] for j, c in enumerate(m) if c == "1")), []).append((k, p))

    def dirty(text):
        w = fold(text)
        for m in masks:
            for p in range(len(w) - len(m) + 1):
                for k, q in seeds.get((m, tuple(w[p + j] for j, c in enumerate(m) if c == "1")), ()):
                    item, shift = items[k], p - q
                    same = [w[i] == item[i - shift] for i in range(max(0, shift), min(len(w), len(item) + shift))]
                    best, low, total, at, span = 0, 0, 0, 0, (0, 0)
                    for i, s in enumerate(same):
                        total += 1 if s else -3
                        if total - low > best:
                            best, span = total - low, (at, i + 1)
                        if total < low:
                            low, at = total, i + 1
                    agree = sum(same[span[0] : span[1]])
                    if agree >= min(13, len(item)) and 100 * agree >= 80 * (span[1] - span[0]):
                        return True
        return False

    return docs[[not dirty(t) for t in docs.text]]


def brute_mix(docs, block=16):
    """Each document's place: slot by slot, the released block with the earliest deadline, by exact fractions."""
    from fractions import Fraction
    from hashlib import md5

    sources = docs.source.fillna("").tolist()
    names = sorted(set(sources))
    most = max(map(sources.count, names))
    weight = {s: Fraction(max(1, round(1000 * (sources.count(s) / most) ** 0.5)), 1000) for s in names}
    share = {s: w / sum(weight.values()) for s, w in weight.items()}
    queue = {s: sorted((i for i, x in zip(docs.doc_id, sources, strict=True) if x == s), key=lambda i: md5(str(i).encode()).hexdigest()) for s in names}
    done, out, slot = dict.fromkeys(names, 0), {}, 0
    while len(out) < len(docs):
        ready = [(-(-(done[s] + 1) // share[s]), k) for k, s in enumerate(names) if done[s] // share[s] <= slot]
        if ready:
            s = names[min(ready)[1]]
            for i in queue[s][done[s] * block : (done[s] + 1) * block]:
                out[i] = len(out)
            done[s] += 1
        slot += 1
    return out


def rows_of(frame):
    return sorted((int(i), t) for i, t in zip(frame.doc_id, frame.text, strict=True))


def test_stages_match_brute_force(spark, folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    want = brute_quality(docs, pd.read_parquet(f"{folder}/labels.parquet"))
    columns = list(docs.columns)
    got = corpus_pipeline.quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert got.columns == columns and rows_of(got.toPandas()) == rows_of(want)
    near = brute_near(want)
    got = corpus_pipeline.near_dedup(spark, got, folder)
    assert got.columns == columns and rows_of(got.toPandas()) == rows_of(near)
    clean = brute_clean(near, pd.read_parquet(f"{folder}/benchmark.parquet"))
    got = corpus_pipeline.decontaminate(spark, got, folder)
    assert got.columns == columns and rows_of(got.toPandas()) == rows_of(clean)
    assert len(docs) > len(want) > len(near) > len(clean) > 0
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    frame = out.toPandas()
    assert rows_of(frame) == rows_of(clean)
    mixed = brute_mix(clean)
    for _, part in frame.groupby("shard"):
        part = part.sort_values("slot")
        assert list(part.slot) == list(range(len(part)))
        assert [mixed[i] for i in part.doc_id] == sorted(mixed[i] for i in part.doc_id)


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.createDataFrame([], spark.read.parquet(f"{SF}/{name}.parquet").schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
