"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Each rule maps a document to a figure of which large values are bad. Its cutoffs run from mild to
strict; a *vector* takes one cutoff (or none) of each rule and rejects what any of them rejects.
For each stratum (language) the vector is chosen on its labelled good documents: the number that a
vector rejects is held against an exact binomial (Clopper-Pearson) bound, and only vectors whose
false rejection rate is certified to be at most ``RISK`` are used. The error ``DELTA`` is halved:

- one half goes to the vectors with the same level for all rules, tested from mild to strict until
  one fails; that order is fixed in advance, so the sequence needs no further correction;
- the other half goes to all vectors there are, by Bonferroni's correction; from the strictest
  certified vector of the sequence single rules are raised in turn, each until it fails.

Over strata Bonferroni's correction holds. With confidence 1 - ``DELTA``, no stratum loses more than
``RISK`` of its good documents to the rules. A stratum with too few labels for any certificate has
no cutoffs and loses nothing to them.

Words are ``[^\\x20\\x09-\\x0D]+``. Independently of the rules a document fails the base test with
fewer than 50 words, or if over half of its words lie in 3-word windows found twice or more.

Defined cases: null and empty texts have no words and fail the base test; a null stratum is a
stratum of its own; labels of one id count as good only if all of them are 1; labels without a
document and null labels are ignored; rows of one id are rows of the result, but one trial in the
bound, by the strictest cutoff that any of them reaches; other columns of ``docs`` may have any name.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, mix, runs, text_buffer
from .workspace import Workspace

RISK, DELTA = 0.02, 0.05
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: strata whose counts the driver may hold
MAX_STRATA = 10_000

#: rule: the figure over counts, and its cutoffs from mild to strict; reached means rejected
RULES = {
    "symbols": ("n_symbols / n_words", (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "shouting": ("n_upper / n_letters", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "dup_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3)),
    "repeats": ("n_repeat_words / n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "long_words": ("word_chars / n_words", (40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
}
#: cutoffs of each rule
LEVELS = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_BLANK = b" \t\n\r\x0b\x0c"


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def count_run(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> dict[str, np.ndarray]:
    """The counts of a run of documents."""
    words = Words(data, offsets, lo, hi, fold=False)
    buf, off = words.text, words.doc_offsets
    n_words = np.diff(words.first)
    out = {"n_words": n_words}
    inside = np.zeros(len(buf) + 1, dtype=np.int8)
    inside[words.starts] += 1
    np.subtract.at(inside, words.ends, 1)
    solid = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out["word_chars"] = _per_doc(solid & ((buf & 0xC0) != 0x80), off)
    out["n_symbols"] = _per_doc(_SYMBOL[buf], off)
    out["n_upper"] = _per_doc(_UPPER[buf], off)
    out["n_letters"] = _per_doc(_LETTER[buf], off)
    out["n_repeat_words"] = _repeat_words(words)
    lines, dups = [], []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        real = [x for x in buf[a:b].tobytes().split(b"\n") if x.strip(_BLANK)]
        lines.append(len(real))
        dups.append(len(real) - len(set(real)))
    out["n_lines"], out["n_dup_lines"] = np.array(lines), np.array(dups)
    return out


def _repeat_words(words: Words) -> np.ndarray:
    grams, whole = words.ngrams(3)
    if not len(grams):
        return np.zeros(words.n_docs, dtype=np.int64)
    doc = np.searchsorted(words.first, np.arange(len(grams)), side="right").astype(np.uint64)
    keyed = grams ^ mix(doc * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(whole)
    order = at[np.argsort(keyed[at], kind="stable")]
    k = keyed[order]
    same = k[1:] == k[:-1]
    again = np.zeros(len(k), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    first = order[again]
    covered = np.zeros(len(words.hashes), dtype=bool)
    for i in range(3):
        covered[first + i] = True
    return _per_doc(covered, words.first)


def _counter(n_carried: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(n_carried))
            parts = [count_run(data, offsets, lo, hi) for lo, hi in runs(offsets)]
            arrays = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, dtype=np.int64), pa.int64()) for c in COUNTS]
            names = [*batch.schema.names[:n_carried], *COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_carried], *arrays], names=names)

    return run


def counted(docs: DataFrame, text_col: str, **carried: str) -> DataFrame:
    """The counts of each document beside carried columns, given as new name = column."""
    kept = docs.select(*[F.col(c).alias(name) for name, c in carried.items()], F.col(text_col).alias("body"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]), *(f"{c} long" for c in COUNTS)])
    return kept.mapInArrow(_counter(len(carried)), schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def _levels() -> dict[str, F.Column]:
    """For each rule, how many of its cutoffs a document reaches."""
    out = {}
    for name, (figure, cutoffs) in RULES.items():
        over, under = (F.col(c) for c in figure.split(" / "))
        out[name] = reduce(lambda a, b: a + b, [F.when((under > 0) & (over >= F.lit(c) * under), 1).otherwise(0) for c in cutoffs])
    return out


def log_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) of a binomial, exactly summed."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1)
    steps = np.log((n - i[1:] + 1.0) / i[1:]) + math.log(p) - math.log1p(-p)
    terms = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = terms.max()
    return float(top + math.log(np.exp(terms - top).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate under which k or fewer of n has probability delta."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid < 1 and log_cdf(k, n, mid) > math.log(delta) else (lo, mid)
    return hi


def chosen_levels(counts: list[tuple[object, dict[tuple[int, ...], int]]], risk: float = RISK, delta: float = DELTA) -> dict[object, dict[str, int]]:
    """For each stratum and rule the number of cutoffs (from mild) of the certified vector.

    ``counts``: stratum, and its good labelled documents by how many cutoffs of each rule they reach.
    """
    along = delta / 2 / max(1, len(counts))
    among = along / (LEVELS + 1) ** len(RULES)
    out: dict[object, dict[str, int]] = {}
    for stratum, found in counts:
        reached = np.array(list(found), dtype=np.int64).reshape(-1, len(RULES))
        n = np.array(list(found.values()), dtype=np.int64)
        good = int(n.sum())

        def certain(vector: list[int], error: float, reached=reached, n=n, good=good) -> bool:
            rejected = ((reached >= vector) & (np.array(vector) > 0)).any(axis=1)
            return good > 0 and upper_bound(int(n[rejected].sum()), good, error) <= risk

        level = 0
        while level < LEVELS and certain([level + 1] * len(RULES), along):
            level += 1
        vector, open_rules = [level] * len(RULES), list(range(len(RULES)))
        while open_rules:
            for r in list(open_rules):
                higher = [x + (k == r) for k, x in enumerate(vector)]
                if higher[r] <= LEVELS and certain(higher, among):
                    vector = higher
                else:
                    open_rules.remove(r)
        out[stratum] = dict(zip(RULES, vector, strict=True))
    return out


def certified(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict[object, dict[str, int]]:
    """Choose the cutoffs on every labelled good document that passes the base test; ``features`` has id, stratum and counts.

    The driver gets one row for each stratum and vector of reached cutoffs, of which there are at
    most 9**5 in a stratum whatever the number of documents.
    """
    good = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("q")).where("id is not null and q is not null").groupBy("id").agg(F.min("q").alias("q")).where("q = 1").select("id")
    levels = _levels()
    trials = features.where(~base_failed()).select("id", "stratum", *[v.alias(k) for k, v in levels.items()]).join(good, "id").groupBy("stratum", "id").agg(*[F.max(rule).alias(rule) for rule in RULES])
    # labelled rows without a document of their stratum add no stratum; the corpus does
    strata = features.groupBy("stratum").count().select("stratum").limit(MAX_STRATA + 1).collect()
    if len(strata) > MAX_STRATA:
        raise ValueError(f"over {MAX_STRATA} strata")
    found: dict[object, dict[tuple[int, ...], int]] = {r["stratum"]: {} for r in strata}
    for r in trials.groupBy("stratum", *RULES).agg(F.count(F.lit(1)).alias("n")).collect():
        found[r["stratum"]][tuple(r[rule] for rule in RULES)] = r["n"]
    return chosen_levels(list(found.items()))


def rejected_by(levels: dict[object, dict[str, int]]) -> dict[str, F.Column]:
    """For each rule, whether it rejects a row that has stratum and counts."""
    out = {}
    for rule, (figure, cutoffs) in RULES.items():
        over, under = (F.col(c) for c in figure.split(" / "))
        known = {s: cutoffs[x[rule] - 1] for s, x in levels.items() if x[rule]}
        test = F.lit(False)
        for cutoff in sorted(set(known.values())):
            named = [s for s, c in known.items() if c == cutoff and s is not None]
            here = F.col("stratum").isin(named) if named else F.lit(False)
            if None in known and known[None] == cutoff:
                here = here | F.col("stratum").isNull()
            test = test | (F.coalesce(here, F.lit(False)) & (under > 0) & (over >= F.lit(cutoff) * under))
        out[rule] = test
    return out


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then stratum, the other counts and the rules that reject: a row for each row of ``docs``."""
    ws = Workspace(docs.sparkSession, "quality")
    features = ws.put(counted(docs, text_col, id=id_col, stratum=stratum_col).withColumn("id", F.col("id").cast("long")), "features")
    tests = rejected_by(certified(features, labels, id_col))
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(rule)) for rule, t in tests.items()]))
    judged = features.withColumn("doc_id", F.col("id")).withColumn("base_failed", base_failed()).withColumn("rejected_by", reasons)
    return judged.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "stratum", *COUNTS[5:], "rejected_by")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their columns; texts are counted once, written beside their counts and never shuffled."""
    ws = Workspace(docs.sparkSession, "quality")
    own = {f"c{k}": c for k, c in enumerate(docs.columns)}
    rows = ws.put(counted(docs, text_col, **own, id=id_col, stratum=stratum_col).withColumn("id", F.col("id").cast("long")), "counted")
    tests = rejected_by(certified(rows, labels, id_col))
    rejected = reduce(lambda a, b: a | b, tests.values())
    return rows.where(~base_failed() & ~rejected).select(*[F.col(k).alias(c) for k, c in own.items()])
