"""Expressions that read the same in Spark SQL and DuckDB, and the SQL of shared steps."""

from __future__ import annotations

#: a path for each document and page: tests, docs, dependencies, builds, code
DOC_PATH = "concat(CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'tests/test_' WHEN 1 THEN 'node_modules/m' WHEN 2 THEN 'docs/d' WHEN 3 THEN 'src/build/b' ELSE 'src/app/a' END, CAST(doc_id AS STRING), CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' WHEN 3 THEN '.min.js' ELSE '.MD' END)"
PAGE_PATH = DOC_PATH.replace("doc_id", "page_id")
ODD_PATH = "concat(CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '.env' WHEN 1 THEN '.env.example' WHEN 2 THEN 'a/.env.local' WHEN 3 THEN 'go.sum' WHEN 4 THEN concat('lib/x', CAST(page_id AS STRING), '.KEY') ELSE concat('lib/y', CAST(page_id AS STRING), '.rs') END)"
CONVERSATION_QUERY = "concat(CASE CAST(turn % 6 AS INT) WHEN 0 THEN 'Find the unit tests for ' WHEN 1 THEN 'show documentation of the Go service, ' WHEN 2 THEN 'Where is the react frontend ' WHEN 3 THEN 'list python and golang code: ' WHEN 4 THEN 'javascript how ' ELSE 'go to ' END, text)"
DOC_KIND = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'function' WHEN 1 THEN 'interface' WHEN 2 THEN 'method' ELSE 'module' END"

BLANK = r"[ \t\n\r\f\x0B]"


def terms(x: str) -> str:
    return rf"regexp_extract_all(replace(lower(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g')), '_', ' '), '[a-z][a-z0-9]+')"


def lines(x: str) -> str:
    split = rf"string_split_regex({x}, '\r\n|\r|\n')"
    return f"(CASE WHEN {split}[-1] = '' THEN {split}[:-2] ELSE {split} END)"


def tokens(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[A-Za-z]+|[0-9]{{1,3}}|[^ \t\n\r\f\x0BA-Za-z0-9]'))"


def hash_score(q: str, d: str) -> str:
    return f"(CAST(('0x' || substr(sha256({q} || {d}), 1, 8)) AS BIGINT) / 4294967295.0::DOUBLE)"


def ranked(name: str, source: str, k: int) -> str:
    return f"{name} AS (SELECT qid, uid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uid) - 1 AS rank FROM {source} WHERE score > 0 QUALIFY rank < {k})"


INDEX = f"""post AS (SELECT uid, term, count(*) AS tf FROM (SELECT doc_id AS uid, unnest({terms('text')}) AS term FROM documents) GROUP BY uid, term),
size AS (SELECT doc_id AS uid, coalesce(l, 0) AS len FROM documents LEFT JOIN (SELECT uid, sum(tf) AS l FROM post GROUP BY uid) p ON p.uid = doc_id)"""
ASKED = f"""said AS (SELECT item_id AS qid, unnest({terms('text')}) AS term FROM benchmark), asked AS (SELECT DISTINCT qid, term FROM said)"""
LEXICAL = f"""{INDEX}, {ASKED}, df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
total AS (SELECT count(*) AS n, greatest(1.0::DOUBLE, avg(len)) AS mean FROM size),
lexical AS (
  SELECT qid, uid, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 9) AS score
  FROM asked JOIN post USING (term) JOIN df USING (term) JOIN size USING (uid), total GROUP BY qid, uid)"""


def _vectors(name: str, source: str, key: str, weight: str) -> str:
    return f"{name} AS (SELECT {key}, dim, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM (SELECT {key}, CAST(('0x' || substr(md5(term), 1, 1)) AS INT) AS dim, CAST({weight} AS DOUBLE) AS w FROM {source} GROUP BY 1, 2))"


DENSE = f"""{_vectors('dv', 'post', 'uid', 'sum(tf)')}, {_vectors('qv', 'said', 'qid', 'count(*)')},
dense AS (SELECT qid, uid, round(sum(qv.w * dv.w), 9) AS score FROM qv JOIN dv USING (dim) GROUP BY qid, uid)"""
CHANNELS = f"{LEXICAL}, {DENSE}, {ranked('lexical_top', 'lexical', 40)}, {ranked('dense_top', 'dense', 40)}"
FUSED = f"{CHANNELS}, fused AS (SELECT qid, uid, round(sum(1.0::DOUBLE / (30 + rank)), 9) AS score FROM (SELECT qid, uid, rank FROM lexical_top UNION ALL SELECT qid, uid, rank FROM dense_top) GROUP BY qid, uid)"
NEAREST = f"""pairs AS (SELECT q.vec_id AS qid, d.vec_id AS uid, d.label, q.embedding AS a, d.embedding AS b FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0),
near AS (SELECT qid, uid, label, round(list_sum(list_transform(range(1, 65), lambda i: a[i]::DOUBLE * b[i]::DOUBLE)), 9) AS score FROM pairs)"""

#: typed edges: parts point at suppliers
EDGES = "SELECT DISTINCT l_partkey AS src, l_suppkey + 10000000 AS dst, CAST(l_linenumber AS DOUBLE) / 10 AS confidence FROM lineitem"
UNIT_SCORE = "CAST({x} * 7919 % 1000 AS DOUBLE) / 1000"
