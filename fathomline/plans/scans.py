"""Queries on scans, units, relations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, graph
from ..sources import store, units
from . import fragments as S
from .registry import query

_SKIP = ", ".join(f"'{d}'" for d in T.SKIP_DIRS)
_ENDS = " OR ".join(f"ends_with(lower(path), '{s}')" for s in T.SKIP_SUFFIXES)
_LOCKS = ", ".join(f"'{n}'" for n in T.LOCKFILES)
_NAME = "string_split(path, '/')[-1]"


def _docs(t):
    return t.documents.select("doc_id", "text", "lang", "source", F.expr(S.DOC_PATH).alias("path"))


@query("scan_path_exclusion", f"""
WITH p AS (SELECT page_id, {S.PAGE_PATH} AS path FROM pages UNION ALL SELECT page_id, {S.ODD_PATH} FROM pages),
j AS (SELECT page_id, path, CASE WHEN len(list_intersect(string_split(path, '/')[:-2], [{_SKIP}])) > 0 THEN 'dependency-or-build-directory'
  WHEN {_NAME} IN ({_LOCKS}) OR {_ENDS} THEN 'generated-or-non-source-name'
  WHEN {_NAME} = '.env' OR (starts_with({_NAME}, '.env.') AND {_NAME} NOT IN ('.env.example', '.env.sample')) THEN 'local-environment' END AS reason FROM p)
SELECT page_id, path, coalesce(reason, CASE WHEN regexp_matches(path, '^src/.*7\\.go$') THEN 'configured' END) AS reason FROM j""")
def _(t):
    paths = t.pages.select("page_id", F.expr(S.PAGE_PATH).alias("path")).unionByName(t.pages.select("page_id", F.expr(S.ODD_PATH).alias("path")))
    return paths.withColumn("reason", F.coalesce(T.path_exclusion(F.col("path")), F.when(F.col("path").rlike(T.glob_pattern("src/*7.go")), "configured")))


_ODD_TEXT = "CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN concat('// Code generated by x. DO NOT EDIT', chr(10), text) WHEN 1 THEN concat(text, chr(1)) WHEN 2 THEN repeat(text, 900) ELSE text END"
_GEN_SQL = T.GENERATED.replace("(?im)", "(?im)")


@query("scan_content_eligibility", f"""
SELECT doc_id, CASE WHEN octet_length(encode(body)) > 1048576 THEN 'file-too-large' WHEN regexp_matches(body, '[\\x01-\\x08\\x0b\\x0e-\\x1f]') THEN 'binary-content'
  WHEN regexp_matches(substr(body, 1, 2048), '{_GEN_SQL}') THEN 'generated-header' END AS reason FROM (SELECT doc_id, {_ODD_TEXT} AS body FROM documents)""")
def _(t):
    return t.documents.select("doc_id", T.eligibility(F.expr(_ODD_TEXT)).alias("reason"))


@query("scan_admission_limits", "SELECT count(*) AS files, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes, count(*) <= 50000 AND coalesce(sum(octet_length(encode(text))), 0) <= 268435456 AS admitted FROM documents")
def _(t):
    return store.admitted(t.documents.select(F.octet_length("text").cast("long").alias("length")))


_LANGS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())


@query("scan_language_routing", f"SELECT doc_id, CASE lower(regexp_extract(string_split(path, '/')[-1], '(\\.[^.]*)$', 1)) {_LANGS} ELSE 'text' END AS language FROM (SELECT doc_id, {S.DOC_PATH} AS path FROM documents)")
def _(t):
    return _docs(t).select("doc_id", T.language_for(F.col("path")).alias("language"))


@query("scan_hash_verify", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, doc_id % 10 <> 0 AS valid FROM documents")
def _(t):
    named = t.documents.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("expected"))
    return t.documents.join(named, "doc_id").select("doc_id", F.sha2("text", 256).alias("sha256"), (F.sha2("text", 256) == F.col("expected")).alias("valid"))


@query("store_bucketing", f"SELECT substr(sha256({S.DOC_PATH}), 1, 2) AS bucket, count(*) AS n, min(sha256({S.DOC_PATH} || chr(1) || text)) AS least_identity FROM documents GROUP BY 1")
def _(t):
    rows = _docs(t).select(F.substring(F.sha2("path", 256), 1, 2).alias("bucket"), T.digest(F.col("path"), F.col("text")).alias("identity"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("identity").alias("least_identity"))


@query("store_dense_reid", "SELECT conv_id, turn, row_number() OVER (ORDER BY sha256('c/' || conv_id), turn) - 1 AS uid FROM conversations")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("start"))
    return units.with_ids(rows).select("conv_id", "turn", "uid")


@query("store_vector_lookup", "SELECT k.key AS vec_id, e.label, e.vec_id IS NOT NULL AS found FROM (SELECT DISTINCT vec_id * 3 AS key FROM embeddings) k LEFT JOIN embeddings e ON e.vec_id = k.key")
def _(t):
    keys = t.embeddings.select((F.col("vec_id") * 3).alias("key")).distinct()
    return keys.join(t.embeddings.select("vec_id", "label"), F.col("key") == F.col("vec_id"), "left").select(F.col("key").alias("vec_id"), "label", F.col("vec_id").isNotNull().alias("found"))


@query("store_text_dedup", "SELECT sha256(text) AS key, min(n) AS bytes, count(*) AS copies FROM (SELECT text, octet_length(encode(text)) AS n FROM documents UNION ALL SELECT text, octet_length(encode(text)) FROM conversations) WHERE text IS NOT NULL GROUP BY 1")
def _(t):
    rows = t.documents.select("text").unionByName(t.conversations.select("text")).where("text is not null").select(F.sha2("text", 256).alias("key"), F.octet_length("text").cast("long").alias("n"))
    return rows.groupBy("key").agg(F.min("n").alias("bytes"), F.count(F.lit(1)).alias("copies"))


@query("embed_norm_check", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) BETWEEN 0.99 AND 1.01 AS valid FROM embeddings")
def _(t):
    norm = F.sqrt(T.cosine(F.col("embedding"), F.col("embedding")))
    return t.embeddings.select("vec_id", F.round(norm, 6).alias("norm"), norm.between(0.99, 1.01).alias("valid"))


@query("units_physical_lines", f"SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, {S.lines('text')} AS l FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.posexplode(T.physical_lines(F.col("text"))).alias("k", "text")).select("doc_id", (F.col("k") + 1).cast("long").alias("line"), "text")


@query("units_text_chunks")
def _(t):
    return units.extract(_docs(t).withColumn("language", F.lit("text")))


@query("units_invariants", f"""
WITH l AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, {S.lines('text')} AS l FROM documents WHERE lang = 'de'))
SELECT doc_id AS path, CAST(line AS INT) AS line, 'uncovered' AS fault FROM l WHERE trim(text, ' ') <> ''""")
def _(t):
    files = t.documents.select(F.col("doc_id").alias("path"), "text")
    # the units of one language are missing
    made = t.documents.where("lang <> 'de'").select(F.col("doc_id").alias("path"), "text", F.lit(1).alias("start"))
    return units.violations(made, files)


@query("units_owner_runs", """
WITH f AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
SELECT conv_id, role, min(turn) AS start, max(turn) AS stop FROM r GROUP BY conv_id, run, role""")
def _(t):
    w = W.partitionBy("conv_id").orderBy("turn")
    flagged = t.conversations.withColumn("new", F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1))
    return flagged.withColumn("run", F.sum("new").over(w)).groupBy("conv_id", "run", "role").agg(F.min("turn").alias("start"), F.max("turn").alias("stop")).drop("run")


@query("rel_member_of", "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer")
def _(t):
    made = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("owner")).unionByName(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("owner")))
    symbols = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("dst")).unionByName(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("dst")))
    return made.join(symbols, F.col("owner") == F.col("dst")).select("src", "dst")


@query("rel_range_join", """
SELECT e.event_id, c.turn FROM (SELECT event_id, user_id % 50 AS conv, event_id % 400 AS line FROM events) e
JOIN conversations c ON c.conv_id = e.conv AND e.line BETWEEN c.turn * 60 AND c.turn * 60 + 54""")
def _(t):
    links = t.events.select((F.col("user_id") % 50).alias("module"), (F.col("event_id") % 400).alias("line"), "event_id")
    spans = t.conversations.select(F.col("conv_id").alias("module"), (F.col("turn") * 60).alias("start"), (F.col("turn") * 60 + 54).alias("end"), "turn")
    return graph.within(links, spans).select("event_id", "turn")


_SYMBOL = "concat('pkg', CAST(page_id % 5 AS STRING), '.mod', CAST(page_id % 23 AS STRING), '.f', CAST(page_id % 61 AS STRING))"


@query("rel_suffix_resolver", f"""
WITH s AS (SELECT DISTINCT {_SYMBOL} AS symbol FROM pages),
x AS (SELECT symbol, unnest([symbol, array_to_string(string_split(symbol, '.')[2:], '.'), string_split(symbol, '.')[3]]) AS name FROM s)
SELECT name, min(symbol) AS symbol FROM x WHERE name IN (SELECT concat('f', CAST(page_id % 61 AS STRING)) FROM pages UNION SELECT concat('mod', CAST(page_id % 23 AS STRING), '.f', CAST(page_id % 61 AS STRING)) FROM pages)
GROUP BY name HAVING count(DISTINCT symbol) = 1""")
def _(t):
    names = t.pages.select(F.expr("concat('f', CAST(page_id % 61 AS STRING))").alias("name")).unionByName(t.pages.select(F.expr("concat('mod', CAST(page_id % 23 AS STRING), '.f', CAST(page_id % 61 AS STRING))").alias("name")))
    return graph.resolve(names, t.pages.select(F.expr(_SYMBOL).alias("symbol")).distinct())


@query("rel_declaration_join", "SELECT p_partkey, p_brand, CAST(count(*) AS BIGINT) AS references_n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def _(t):
    # references are summed per declaration before they meet it
    seen = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("references_n"))
    return seen.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "p_brand", "references_n")


@query("rel_same_symbol", "SELECT a.conv_id, a.turn AS src, b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn")
def _(t):
    a = t.conversations.select("conv_id", F.col("turn").alias("src"))
    return a.join(t.conversations.select("conv_id", F.col("turn").alias("dst")), "conv_id").where("src <> dst")


@query("rel_dedupe", "SELECT l_orderkey AS src, list_sort(list(DISTINCT l_suppkey)) AS edges FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("src")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("edges"))


@query("connect_normalize_blocks", f"SELECT doc_id, concat({S.DOC_PATH}, chr(10), array_to_string(list_transform(range(1, len(l) + 1), lambda i: concat(i, chr(9), l[i])), chr(10))) AS block FROM (SELECT doc_id, {S.lines('text')} AS l FROM documents)")
def _(t):
    return _docs(t).select("doc_id", T.render(F.col("path"), F.lit(1), F.col("text")).alias("block"))


@query("fn_terms", f"SELECT doc_id, len({S.terms('text')}) AS n_terms, len(list_distinct({S.terms('text')})) AS n_distinct FROM documents")
def _(t):
    found = T.terms(F.col("text"))
    return t.documents.select("doc_id", F.size(found).cast("long").alias("n_terms"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


@query("fn_document", f"SELECT doc_id, substr(concat_ws(chr(10), {S.DOC_PATH}, source, text), 1, 2200) AS document FROM documents")
def _(t):
    return _docs(t).select("doc_id", T.document(F.col("path"), F.col("source"), F.col("text")).alias("document"))


@query("fn_render", f"SELECT conv_id, turn, concat('c/', conv_id, chr(10), array_to_string(list_transform(range(1, len(l) + 1), lambda i: concat(i + turn * 10, chr(9), l[i])), chr(10))) AS rendered FROM (SELECT *, {S.lines('text')} AS l FROM conversations)")
def _(t):
    return t.conversations.select("conv_id", "turn", T.render(F.concat(F.lit("c/"), "conv_id"), F.col("turn") * 10 + 1, F.col("text")).alias("rendered"))


@query("fn_token_cost", f"SELECT doc_id, {S.tokens('text')} + 2 AS cost FROM documents")
def _(t):
    return t.documents.select("doc_id", T.token_cost(F.col("text")).cast("long").alias("cost"))


@query("fn_source_role", f"SELECT page_id, CASE WHEN regexp_matches(lower(path), '{T.TEST_PATH}') THEN 'test' WHEN regexp_matches(lower(path), '{T.DOC_PATH}') THEN 'documentation' ELSE 'implementation' END AS role FROM (SELECT page_id, {S.PAGE_PATH} AS path FROM pages)")
def _(t):
    return t.pages.select("page_id", T.source_role(F.expr(S.PAGE_PATH), F.lit("python")).alias("role"))


@query("fn_requested_role", f"SELECT conv_id, turn, CASE WHEN regexp_matches(q, '{T.ASKS_TEST}') THEN 'test' WHEN regexp_matches(q, '{T.ASKS_DOC}') THEN 'documentation' ELSE 'implementation' END AS role FROM (SELECT conv_id, turn, {S.CONVERSATION_QUERY} AS q FROM conversations)")
def _(t):
    return t.conversations.select("conv_id", "turn", T.requested_role(F.expr(S.CONVERSATION_QUERY)).alias("role"))


_SCOPES = ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN {v} ELSE [] END" for p, v in T.SCOPES)


@query("fn_requested_languages", f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(flatten([{_SCOPES}]))), ',') AS languages FROM (SELECT conv_id, turn, {S.CONVERSATION_QUERY} AS q FROM conversations)")
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(T.requested_languages(F.expr(S.CONVERSATION_QUERY)), ",").alias("languages"))


@query("fn_plan_query")
def _(t):
    asked = F.concat(F.lit("When a user returns, how is "), F.col("text"), F.lit(" loaded and where is it saved"))
    return t.benchmark.select("item_id", F.posexplode(T.facets(asked)).alias("k", "f")).select("item_id", "k", "f.question", F.array_join("f.terms", " ").alias("terms"))


@query("fn_facet_prompt", "SELECT item_id, concat_ws('|', q, a || chr(10) || 'Context for this part of the request: ' || q, b || chr(10) || 'Context for this part of the request: ' || q) AS prompts FROM (SELECT item_id, text AS q, 'a' || item_id AS a, 'b' || item_id AS b FROM benchmark)")
def _(t):
    parts = F.array(F.concat(F.lit("a"), "item_id"), F.col("text"), F.concat(F.lit("b"), "item_id"), F.concat(F.lit("a"), "item_id"))
    return t.benchmark.select("item_id", F.array_join(T.prompts(F.col("text"), parts), "|").alias("prompts"))


@query("fn_substance", f"""
WITH d AS (SELECT doc_id, {S.DOC_KIND} AS kind, {S.DOC_PATH} AS path, len(list_filter(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '{T.NOT_EXECUTABLE}'))) AS n FROM documents)
SELECT doc_id, CAST(CASE WHEN regexp_matches(lower(path), '{T.TEST_PATH}') OR regexp_matches(lower(path), '{T.DOC_PATH}') THEN 1.0 WHEN kind = 'interface' THEN 0.25
  WHEN n = 0 THEN 0.1 WHEN kind IN ('function', 'method') THEN CASE WHEN n >= 2 THEN 1.0 ELSE 0.5 END WHEN n >= 5 THEN 1.0 ELSE 0.25 END AS DOUBLE) AS substance FROM d""")
def _(t):
    role = T.source_role(F.col("path"), F.lit("python"))
    return _docs(t).select("doc_id", T.substance(role, F.expr(S.DOC_KIND), F.col("text")).cast("double").alias("substance"))


@query("fn_gain_value", """
WITH e AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS r, CAST(vec_id % 20 AS INT) AS k, 60 + vec_id % 700 AS cost FROM embeddings)
SELECT vec_id, round(CASE WHEN r < 0.1 THEN 0.0::DOUBLE ELSE (r * 0.5::DOUBLE + exp(-k / 8.0::DOUBLE) * 0.5::DOUBLE) * 0.5::DOUBLE * 1.0::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END END, 6) AS value,
       round(pow(greatest(120, cost) / 300.0::DOUBLE, 0.35::DOUBLE), 6) AS damp FROM e""")
def _(t):
    r, k = F.abs(F.get("embedding", 0).cast("double")), (F.col("vec_id") % 20).cast("int")
    worth = T.value(r, k, F.lit(0.5), F.lit(1.0), F.col("vec_id") % 3 == 0)
    return t.embeddings.select("vec_id", F.round(worth, 6).alias("value"), F.round(T.size_damp(F.col("vec_id") % 700 + 60), 6).alias("damp"))


@query("fn_digest", f"SELECT doc_id, sha256(concat_ws(chr(1), 'local', 'hashed', '16', text)) AS cache_key FROM documents")
def _(t):
    return t.documents.select("doc_id", T.digest(F.lit("local"), F.lit("hashed"), F.lit("16"), F.col("text")).alias("cache_key"))


@query("win_gap_islands", """
WITH l AS (SELECT DISTINCT user_id AS path, event_id % 997 AS line FROM events), g AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run FROM l)
SELECT path, min(line) AS start, max(line) AS stop, count(*) AS n FROM g GROUP BY path, run""")
def _(t):
    return evaluate.islands(t.events.select(F.col("user_id").alias("path"), (F.col("event_id") % 997).alias("line")))
