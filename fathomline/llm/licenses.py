r"""License scans: MinHash bands over overlapping windows, then exact containment.

Words are the runs of ``[a-z0-9]`` of a text in ASCII lower case. Templates and documents are
compared by their 5-word shingles. Templates of equally many distinct shingles L form a class; a class scans each
document with windows of L shingles that begin every max(1, L // 4) shingles.

1. A window's signature has ``BANDS`` bands of one minimum each (a shingle's 64-bit hash XOR the
   band's constant). A window that agrees with a template in a band retrieves it. Equal minima are
   a shared shingle, so signatures are made for the windows that share one with the class and for
   no others, which loses nothing.
   The window nearest to a copy with a containment of 0.8 or more holds at least
   0.675 L of the template's shingles, a Jaccard similarity of 0.5 or more, so ``BANDS`` = 20 bands
   miss it with a probability below 1e-6; for L < 5 that window equals the template.
2. Around each retrieved window the document's shingles are compared as they are with those of the
   template: the best stretch of ceil(1.25 L) shingles counts, and a containment of
   ``PERCENT`` % or more is a match.

Documents without any shared shingle are passed over after one look at their hashes. Only matches
are shuffled.
All of it is DataFrame expressions. The templates are a parameter; they are sent to all tasks in
slices of at most ``SLICE_SHINGLES`` shingles (a longer template is a slice by itself), each of which scans all documents.

Defined cases: null and empty texts match nothing; a text or template of fewer than five words is one
shingle; rows of one id are one document with the best match of any; null ids are one document named by null.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

SHINGLE = 5
PERCENT = 80
BANDS = 20
SLICE_SHINGLES = 20_000
#: odd multiples of 2**64 over the golden ratio, as signed numbers
_SALTS = [((k * 0x9E3779B97F4A7C15 + 2**63) % 2**64) - 2**63 for k in range(1, BANDS + 1)]


def _words(text: F.Column) -> F.Column:
    # extraction is many times faster than a split by the opposite class
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def _let(value: F.Column, body) -> F.Column:
    """``body(value)`` with the value computed once for a row, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(w: F.Column, make) -> F.Column:
    """A value for each place of a shingle; a shorter text has one place."""
    # the windows that run over the end go, but for that of a short text
    return _let(w, lambda w: F.slice(F.transform(w, lambda _, i: make(F.slice(w, i + 1, SHINGLE))), F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))))


def hashes(w: F.Column) -> F.Column:
    return _places(w, lambda part: F.xxhash64(part))


def shingles(w: F.Column) -> F.Column:
    return _places(w, lambda part: F.array_join(part, " "))


def _template_sets(spark, templates: dict[str, str]) -> dict[str, tuple[list[int], list[str]]]:
    """Distinct shingle hashes and shingles of each template, by the same expressions as documents."""
    frame = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", _words(F.col("text")).alias("w"))
    rows = frame.select("name", F.array_distinct(hashes(F.col("w"))).alias("h"), F.array_distinct(shingles(F.col("w"))).alias("s")).where("size(h) > 0").collect()
    return {r["name"]: (list(r["h"]), list(r["s"])) for r in rows}


def _minima(found: list[int]) -> list[int]:
    return [min(h ^ c for h in found) for c in _SALTS]


def _windows(h: F.Column, hits: F.Column, length: int) -> F.Column:
    """The windows of a class that hold a hit, each with its bands' minima; the last ones are shorter."""
    step = max(1, length // 4)
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - length + 1) / step)).cast("int")
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(first(x["at"]), F.floor(x["at"] / step).cast("int")))))
    salts = F.array(*[F.lit(c) for c in _SALTS])
    minima = lambda part: F.transform(salts, lambda c: F.array_min(F.transform(part, lambda x: x.bitwiseXOR(c))))
    return F.transform(starts, lambda q: F.struct((q * step).alias("at"), _let(F.slice(h, q * step + 1, length), minima).alias("low")))


def _span(length: int) -> int:
    """Shingles of the longest stretch that is held against a template."""
    return math.ceil(1.25 * length)


def _agreeing(minima: dict[str, list[int]], span: int):
    """(template, place, span) of the windows that agree with a template of their class in a band."""

    def agreeing(windows: F.Column) -> F.Column:
        return F.concat(*[one(windows, name, F.array(*[F.lit(m) for m in own])) for name, own in minima.items()])

    def one(windows: F.Column, name: str, own: F.Column) -> F.Column:
        agree = lambda x: F.exists(F.zip_with(x["low"], own, lambda a, b: a == b), lambda same: same)
        return F.transform(F.filter(windows, agree), lambda x: F.struct(F.lit(name).alias("template"), x["at"].alias("at"), F.lit(span).alias("span")))

    return agreeing


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, template, n_shared, n_template, first_word: the best match of each document and template."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    sets = _template_sets(spark, templates)
    schema = "doc_id long, template string, n_shared long, n_template long, first_word long"
    if not sets:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [_scan_slice(docs, part, id_col, text_col) for part in _slices(sets)])


def _slices(sets: dict[str, tuple[list[int], list[str]]]) -> list[dict[str, tuple[list[int], list[str]]]]:
    """The templates in groups of at most ``SLICE_SHINGLES`` shingles; matches of a template do not depend on the others."""
    out: list[dict] = [{}]
    size = 0
    for name, own in sets.items():
        if out[-1] and size + len(own[0]) > SLICE_SHINGLES:
            out.append({})
            size = 0
        out[-1][name] = own
        size += len(own[0])
    return out


def _scan_slice(docs: DataFrame, sets: dict[str, tuple[list[int], list[str]]], id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    known = {h for own, _ in sets.values() for h in own}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    near = rows.where(F.exists(hashes(_words(F.col("body"))), lambda x: x.isin(sorted(known))))
    classes: dict[int, list[str]] = {}
    for name, (own, _) in sets.items():
        classes.setdefault(len(own), []).append(name)

    def in_class(h: F.Column, hits: F.Column, length: int, names: list[str]) -> F.Column:
        """What the windows of one class retrieve; only those that share a shingle with a template can agree in a minimum."""
        shared = sorted({x for name in names for x in sets[name][0]})
        windows = _let(F.filter(hits, lambda x: x["h"].isin(shared)), lambda own: _windows(h, own, length))
        return _let(windows, _agreeing({name: _minima(sets[name][0]) for name in names}, _span(length)))

    def by_class(h: F.Column) -> F.Column:
        hits = F.filter(F.transform(h, lambda x, i: F.struct(i.alias("at"), x.alias("h"))), lambda x: x["h"].isin(sorted(known)))
        return _let(hits, lambda hits: F.array_distinct(F.concat(*[in_class(h, hits, n, names) for n, names in sorted(classes.items())])))

    def retrieved(w: F.Column) -> F.Column:
        """Each retrieved template once for a place, with the words around it."""
        lo = lambda x: F.greatest(F.lit(0), x["at"] - x["span"])
        return F.transform(_let(hashes(w), by_class), lambda x: F.struct(x["template"].alias("template"), lo(x).alias("lo"), F.slice(w, lo(x) + 1, 3 * x["span"] + SHINGLE - 1).alias("words")))

    # an inner explode would have the windows computed again, to filter by their number
    hit = near.select("doc_id", F.explode_outer(_let(_words(F.col("body")), retrieved)).alias("c")).where("c is not null").select("doc_id", "c.template", "c.lo", "c.words")
    own = spark.createDataFrame([(name, len(s), _span(len(s)), s) for name, (_, s) in sets.items()], "template string, n_template long, span int, own array<string>")
    lo, span = F.col("lo"), F.col("span")
    # places of the template's shingles near the window, then the stretch that has most of them
    places = F.filter(F.transform(shingles(F.col("words")), lambda s, i: F.struct(i.alias("at"), s.alias("s"))), lambda x: F.array_contains("own", x["s"]))

    def best(places: F.Column) -> F.Column:
        shared = lambda a: F.size(F.array_distinct(F.transform(F.filter(places, lambda b: (b["at"] >= a["at"]) & (b["at"] < a["at"] + span)), lambda b: b["s"])))
        return F.array_max(F.transform(places, lambda a: F.struct(shared(a).cast("long").alias("n_shared"), (-(lo + a["at"])).cast("long").alias("before"))))

    scored = hit.join(F.broadcast(own), "template").select("doc_id", "template", "n_template", _let(places, best).alias("best"))
    top = scored.groupBy("doc_id", "template", "n_template").agg(F.max("best").alias("best")).where(F.col("best.n_shared") * 100 >= F.col("n_template") * PERCENT)
    return top.select("doc_id", "template", F.col("best.n_shared").alias("n_shared"), "n_template", (-F.col("best.before")).alias("first_word"))


def sql(templates: dict[str, str] | None = None) -> str:
    """DuckDB SQL of ``scan``: every stretch of every document, without retrieval."""
    templates = TEMPLATES if templates is None else templates
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    words = "list_transform(list_filter(string_split_regex(coalesce(text, ''), '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x))"
    cut = f"CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""
WITH template AS (SELECT name, {words} AS w FROM (VALUES {values}) AS t(name, text)),
own AS (SELECT DISTINCT name, unnest({cut}) AS s FROM template),
size AS (SELECT name, count(*) AS n, CAST(ceil(1.25 * count(*)) AS INTEGER) AS span FROM own GROUP BY name),
doc AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
place AS (SELECT r, doc_id, unnest(s) AS s, unnest(range(0, len(s))) AS pos FROM (SELECT r, doc_id, {cut} AS s FROM doc)),
hit AS (SELECT r, doc_id, name, s, pos FROM place JOIN own USING (s)),
stretch AS (
  SELECT a.doc_id, a.name, a.pos, z.n, count(DISTINCT b.s) AS shared
  FROM hit a JOIN size z USING (name) JOIN hit b ON a.r = b.r AND a.name = b.name AND b.pos >= a.pos AND b.pos < a.pos + z.span
  GROUP BY a.r, a.doc_id, a.name, a.pos, z.n
), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY shared DESC, pos) AS k FROM stretch WHERE shared * 100 >= n * {PERCENT})
SELECT doc_id, name AS template, CAST(shared AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_template, CAST(pos AS BIGINT) AS first_word FROM ranked WHERE k = 1
"""
