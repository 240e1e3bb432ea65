"""Queries on code: relations, adapters, bundles, the index, embeddings, coverage and answers."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import evidence, index
from ..functions import text as T
from ..operators import coverage, evaluate, graph, scoring
from ..sources import backends, braces, relations, shared, units
from . import fragments as S
from .registry import Tables, query


def _folder(t: Tables, name: str) -> str:
    return f"{shared.checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _files(t: Tables, ending: str, language: str, text) -> DataFrame:
    """A file for each supplier; it uses the next one of its nation, which makes its folder."""
    after = F.lead("s_suppkey").over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rows = shared.spread(t.supplier.select("s_suppkey", "s_nationkey", after.alias("next")), t.supplier.count(), "s_suppkey")
    path = F.concat(F.lit("n"), "s_nationkey", F.lit("/s"), "s_suppkey", F.lit(ending))
    return rows.select(path.alias("path"), text.alias("text"), F.lit(language).alias("language"))


def _lines(*parts) -> F.Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


_NEXT = "WITH f AS (SELECT s_suppkey AS k, s_nationkey AS n, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS next FROM supplier)"


def _edges(found: DataFrame, made: DataFrame) -> DataFrame:
    named = found.join(made.select(F.col("uid").alias("src"), F.col("symbol").alias("source")), "src").join(made.select(F.col("uid").alias("dst"), F.col("symbol").alias("target")), "dst")
    return named.select("source", "target", "kind", "confidence").distinct()


@query("relations_python", _NEXT + """, p AS (SELECT *, 'n' || n || '/s' || k || '.py' AS path, 'n' || n || '/s' || next || '.py' AS other FROM f)
SELECT path || '.run' AS source, other || '.run' AS target, kind, 0.7::DOUBLE AS confidence FROM p, (VALUES ('calls'), ('references_value')) AS v(kind) WHERE next IS NOT NULL
UNION ALL SELECT path, other || '.run', 'imports', 1.0 FROM p WHERE next IS NOT NULL
UNION ALL SELECT path || '.Box', path || '.Base', kind, 0.7 FROM p, (VALUES ('inherits'), ('references_value')) AS v(kind)
UNION ALL SELECT path || '.Box.put', path || '.Box', 'member_of', 1.0 FROM p
UNION ALL SELECT path || '.Box.put', path || '.Box', 'references_value', 0.7 FROM p
UNION ALL SELECT path || '.Box.put', path || '.Box.get', 'calls', 0.7 FROM p
UNION ALL SELECT path || '.Box.get', path || '.Box', 'member_of', 1.0 FROM p
UNION ALL SELECT path || '.Box.get', path || '.run', 'references_value', 0.6 FROM p""")
def _(t):
    """Imports under another name, calls, bases, self and documentation links, resolved over all files."""
    use = F.when(F.col("next").isNotNull(), F.concat(F.lit("from .s"), F.col("next").cast("string"), F.lit(" import run as go"))).otherwise("go = len")
    text = _lines(use, "", "class Base:", "    x = 1", "", "class Box(Base):", "    def put(self, item):", "        return self.get(item)", "", "    def get(self, go):", "        # :func:`run`", "        return go(1)", "", "def run(x):", "    return go(x)")
    files = _files(t, ".py", "python", text)
    made = shared.cut(units.with_ids(units.extract(files)))
    return _edges(relations.relations(files, made), made)


@query("search_evidence")
def _(t):
    """Evidence for every benchmark item over the Python units of all suppliers' files and their resolved relations."""
    use = F.when(F.col("next").isNotNull(), F.concat(F.lit("from .s"), F.col("next").cast("string"), F.lit(" import run as go"))).otherwise("go = len")
    text = _lines(use, "class Base:", "    x = 1", "class Box(Base):", "    def put(self, item):", "        return self.get(item)", "    def get(self, go):", "        # :func:`run`", "        return go(1)", "def run(x):", "    return go(x)")
    files = _files(t, ".py", "python", text)
    made = shared.cut(units.with_ids(shared.cut(units.extract(files))))
    found = shared.cut(relations.relations(files, made))
    rows = made.join(files.select("path", "language"), "path").select(*index.COLUMNS)
    built = index.build(rows, f"{shared.checkpoint_dir(t.spark)}/index-{index.identity_of(rows)}")
    said = asked(t).select("qid", F.concat(F.lit("how does run get an item and put it in a box: "), "query").alias("query"))
    return evidence.gather(built, found, said, 4000)


@query("relations_histogram", _NEXT + " SELECT v.kind, CAST(count(*) * v.each + count(next) * v.linked AS BIGINT) AS n FROM f, (VALUES ('calls', 1, 1), ('references_value', 3, 1), ('imports', 0, 1), ('inherits', 1, 0), ('member_of', 2, 0)) AS v(kind, each, linked) GROUP BY v.kind, v.each, v.linked HAVING count(*) * v.each + count(next) * v.linked > 0")
def _(t):
    use = F.when(F.col("next").isNotNull(), F.concat(F.lit("from .s"), F.col("next").cast("string"), F.lit(" import run as go"))).otherwise("go = len")
    text = _lines(use, "class Base:", "    x = 1", "class Box(Base):", "    def put(self, item):", "        return self.get(item)", "    def get(self, go):", "        # :func:`run`", "        return go(1)", "def run(x):", "    return go(x)")
    files = _files(t, ".py", "python", text)
    made = shared.cut(units.with_ids(units.extract(files)))
    return relations.kind_histogram(_edges(relations.relations(files, made), made))


@query("relations_typescript", _NEXT + """, p AS (SELECT *, 'n' || n || '/s' || k || '.ts' AS path, 'n' || n || '/s' || next || '.ts' AS other FROM f)
SELECT path || '.Box.put' AS source, other || '.run' AS target, 'calls' AS kind, 0.9::DOUBLE AS confidence FROM p WHERE next IS NOT NULL
UNION ALL SELECT path, other, 'imports', 1.0 FROM p WHERE next IS NOT NULL
UNION ALL SELECT path || '.run', path || '.help', 'calls', 0.9 FROM p
UNION ALL SELECT path || '.Box', path || '.Base', 'inherits', 0.9 FROM p""")
def _(t):
    use = F.when(F.col("next").isNotNull(), F.concat(F.lit("import { run as go } from './s"), F.col("next").cast("string"), F.lit("'"))).otherwise("// nothing { is used")
    text = _lines(use, "class Base {", "}", "export class Box extends Base {", "  put(x: string) {", "    return go(x) // }", "  }", "}", "const help = (x: string) => `${x} {`", "export function run(x: string) {", "  return help(x)", "}")
    files = _files(t, ".ts", "typescript", text)
    made = shared.cut(units.with_ids(units.extract(files)))
    return _edges(braces.brace_relations(files, made), made)


@query("relations_go", _NEXT + " SELECT 'n' || n || '/s' || k || '.go.Box.Put' AS source, 'n' || n || '/s' || coalesce(next, k) || '.go.Run' || coalesce(next, k) AS target, 'calls' AS kind, 0.9::DOUBLE AS confidence FROM f")
def _(t):
    call = F.concat(F.lit("\treturn Run"), F.coalesce("next", "s_suppkey").cast("string"), F.lit("(x) // }"))
    text = _lines("package n", "", "type Box struct {", "\tx int", "}", "", "func (b *Box) Put(x int) int {", call, "}", "", F.concat(F.lit("func Run"), F.col("s_suppkey").cast("string"), F.lit("(x int) int {")), "\tprintln(`}`)", "\treturn x", "}")
    files = _files(t, ".go", "go", text)
    made = shared.cut(units.with_ids(units.extract(files)))
    return _edges(braces.brace_relations(files, made), made)


@query("units_go", _NEXT + """, p AS (SELECT 'n' || n || '/s' || k || '.go' AS path, k FROM f)
SELECT path, path AS symbol, 'module' AS kind, 1 AS start, 2 AS stop FROM p UNION ALL SELECT path, path || '.Box', 'type', 3, 5 FROM p
UNION ALL SELECT path, path || '.Box.Put', 'method', 7, 9 FROM p UNION ALL SELECT path, path || '.Run', 'function', 11, 11 FROM p""")
def _(t):
    text = _lines("package n", "", "type Box struct {", "\tx int // }", "}", "", "func (b *Box) Put(x int) int {", "\treturn Run(x)", "}", "", "func Run(x int) int { return x }")
    return units.extract(_files(t, ".go", "go", text)).select("path", "symbol", "kind", "start", "stop")


@query("graph_context_bundles")
def _(t):
    """Turns of a conversation are functions that their next turn calls; a function's text is one or two units."""
    name = F.concat_ws("/", "conv_id", "turn")
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), name.alias("symbol"), F.lit(None).cast("string").alias("owner"), F.when(F.col("role") == "system", "module").otherwise("function").alias("kind"), T.token_cost(F.col("text")).cast("long").alias("cost"))
    calls = rows.select((F.col("uid") + 1).alias("src"), F.col("uid").alias("dst"))
    return graph.bundles(rows, calls).select("uid", F.array_join(F.transform("bundle", lambda x: x.cast("string")), ",").alias("bundle"))


def _units(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("uid"), F.expr(S.DOC_PATH).alias("path"), F.col("source").alias("symbol"), F.col("lang").alias("language"), F.lit("text").alias("kind"), F.lit(1).alias("start"), "text")


def documents_index(t: Tables) -> index.Index:
    """An index of the documents' texts in the shared folder, named by their content: built by the first call, restored by the others."""
    rows = _units(t)
    return index.build(rows, f"{shared.checkpoint_dir(t.spark)}/index-{index.identity_of(rows)}", body=F.col("text"))


def asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query("index_restore", f"WITH {S.INDEX} SELECT uid, CAST(len AS BIGINT) AS len FROM size")
def _(t):
    """Build, open with all checks, and read the lengths back."""
    built = documents_index(t)
    root = f"{shared.checkpoint_dir(t.spark)}/index-{built.info['identity']}"
    return index.open_index(t.spark, root, built.info["identity"]).lengths


class _Hashed:
    """Stands in for a model: four numbers from each text's digest."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        from hashlib import sha256

        return np.array([[sha256(x.encode()).digest()[k] / 255 for k in range(4)] for x in texts], dtype=np.float32)


@query("embed_batches", "SELECT DISTINCT sha256(text) AS key, round(('0x' || substr(sha256(text), 1, 2))::INT / 255.0::DOUBLE, 3) AS x, round(('0x' || substr(sha256(text), 7, 2))::INT / 255.0::DOUBLE, 3) AS y FROM documents WHERE text IS NOT NULL")
def _(t):
    """Distinct texts embedded in batches into a vector store; a second call finds nothing missing."""
    root = _folder(t, "vectors")
    rows = t.documents.where("text is not null").select(F.sha2("text", 256).alias("key"), "text")
    first = backends.embed_missing(root, rows, _Hashed())
    if backends.embed_missing(root, rows, _Hashed()) or first == 0:
        raise AssertionError("the store lost vectors")
    value = lambda k: F.round(F.get("vec", F.lit(k)).cast("double"), 3)
    return t.spark.read.parquet(root).select("key", value(0).alias("x"), value(3).alias("y"))


@query("score_second_wave", f"""
WITH s AS (SELECT conv_id AS qid, turn AS uid, {S.UNIT_SCORE.format(x='(conv_id * 31 + turn)')} / 4 AS score FROM conversations), n AS (SELECT qid, count(*) AS n, max(score) AS best FROM s GROUP BY 1)
SELECT DISTINCT c.conv_id AS qid, CASE WHEN n > 1 AND best < 0.1 THEN CAST(turn % 3 AS INT) ELSE 0 END AS facet, turn AS uid FROM conversations c JOIN n ON n.qid = c.conv_id""")
def _(t):
    scores = t.conversations.select(F.col("conv_id").alias("qid"), F.col("turn").alias("uid"), (F.expr(S.UNIT_SCORE.format(x="(conv_id * 31 + turn)")) / 4).alias("score"))
    policy = scoring.full_facets(scores, scores.groupBy("qid").agg(F.count(F.lit(1)).alias("n")))
    return scoring.second_wave(scores.select("qid", (F.col("uid") % 3).cast("int").alias("facet"), "uid"), policy)


@query("score_mapped_chunks", "SELECT conv_id AS qid, turn AS uid, round(turn / 100.0::DOUBLE, 6) AS score FROM conversations")
def _(t):
    """Requests of four documents, answered in reverse, mapped back."""
    requests = scoring.chunked(t.conversations.select(F.col("conv_id").alias("qid"), F.col("turn").alias("uid")), 4)
    answers = F.reverse(F.transform("uids", lambda u, k: F.struct(k.alias("index"), (u / 100).alias("relevance_score"))))
    return scoring.mapped(requests, requests.select("qid", "request", answers.alias("results"))).select("qid", "uid", F.round("score", 6).alias("score"))


@query("eval_last_written", f"""
WITH l AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, {S.lines('text')} AS l FROM documents)),
w AS (SELECT doc_id % 50 AS path, line, text, doc_id AS age FROM l) SELECT path, CAST(line AS INT) AS line, arg_max(text, age) AS text FROM w GROUP BY path, line""")
def _(t):
    rows = t.documents.select((F.col("doc_id") % 50).alias("path"), F.col("doc_id").alias("at"), F.posexplode(T.physical_lines(F.col("text"))).alias("k", "text"))
    return evaluate.last_written(rows.select("path", (F.col("k") + 1).alias("line"), "text", "at")).select("path", "line", "text")


_SOURCES = "src AS (SELECT 'd/' || doc_id AS path, doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query("eval_anchor_score", f"""
WITH {_SOURCES}, e AS (SELECT doc_id AS task, path, l, 1 AS a, least(len(l), 1 + CAST(doc_id % 50 AS INT)) AS b FROM src),
v AS (SELECT *, b - a + 1 <= 40 AND doc_ok AND trim(array_to_string(l[a:b], chr(10)), ' ' || chr(9) || chr(10) || chr(13)) <> '' AS valid FROM (SELECT *, task % 9 <> 0 AS doc_ok FROM e)),
u AS (SELECT task, valid AND contains(array_to_string(l[a:b], chr(10)), 'the') AS c0, valid AND contains(array_to_string(l[a:b], chr(10)), 'of') AS c1 FROM v)
SELECT task, CAST(valid AS BIGINT) AS valid, CAST(NOT valid AS BIGINT) AS invalid, CAST(2 AS BIGINT) AS units, CASE WHEN task % 7 <> 0 THEN CAST(c0 AS BIGINT) + CAST(c0 AND c1 AS BIGINT) ELSE 0 END AS covered, task % 7 <> 0 AS in_budget FROM v JOIN u USING (task)""")
def _(t):
    """Each document cites its own head: one in nine with a changed quote, some over 40 lines, one in seven in too long an answer."""
    sources = t.documents.select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), "text")
    lines = F.split("text", "\n")
    stop = F.least(F.size(lines), (F.col("doc_id") % 50).cast("int") + 1)
    quote = F.concat(F.when(F.col("doc_id") % 9 == 0, "no ").otherwise("  "), F.array_join(F.slice(lines, F.lit(1), stop), "\n"))
    cited = sources.select(F.col("doc_id").alias("task"), "path", F.lit(1).alias("start"), stop.alias("stop"), quote.alias("quote"))
    anchors = sources.select(F.col("doc_id").alias("task"), "path", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(a).alias("anchor")) for u, a in ((0, "the"), (1, "the"), (1, "of"))])).alias("x")).select("task", "path", "x.unit", "x.anchor")
    sizes = sources.select(F.col("doc_id").alias("task"), F.when(F.col("doc_id") % 7 == 0, 16_001).otherwise(500).alias("chars"))
    return evaluate.anchor_score(cited, anchors, sources.drop("doc_id"), sizes)


@query("eval_gold_faults", f"""
WITH {_SOURCES}, g AS (SELECT *, CAST(doc_id % 5 AS INT) AS case_ FROM src)
SELECT doc_id AS task, 0 AS unit, 0 AS alternative, 0 AS k, CASE case_ WHEN 1 THEN 'bounds' WHEN 2 THEN 'changed' WHEN 3 THEN 'no-source' ELSE 'repeated' END AS fault FROM g WHERE case_ > 0""")
def _(t):
    """The first lines of documents as gold: right, out of bounds, changed, without a source, or named twice."""
    sources = t.documents.select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), "text")
    case = (F.col("doc_id") % 5).cast("int")
    quote = F.get(T.physical_lines(F.col("text")), F.lit(0))
    one = sources.select(F.col("doc_id").alias("task"), F.lit(0).alias("unit"), F.lit(0).alias("alternative"), F.lit(0).alias("k"), F.when(case == 3, "gone").otherwise(F.col("path")).alias("path"), F.lit(1).alias("start"), F.when(case == 1, 1_000_000).otherwise(1).alias("stop"), F.when(case == 2, F.concat(quote, F.lit("!"))).otherwise(quote).alias("quote"), F.sha2(quote, 256).alias("sha256"), case.alias("case"))
    return evaluate.gold_faults(one.unionByName(one.where("case = 4")).drop("case"), sources.drop("doc_id"))


@query("fn_literal_facets", "SELECT item_id, array_to_string(CASE WHEN len(p) BETWEEN 2 AND 4 THEN p ELSE [q] END, '|') AS facets FROM (SELECT item_id, q, list_filter(list_transform(string_split_regex(regexp_replace(q, '(?:,\\s+|\\s+and\\s+)(how|which|why|where|what)', ';\\1', 'gi'), '[:;，；：]'), lambda x: trim(x)), lambda x: length(x) > 7) AS p FROM (SELECT item_id, 'find this: ' || text || '; then report' AS q FROM benchmark))")
def _(t):
    rows = t.benchmark.select("item_id", F.concat(F.lit("find this: "), "text", F.lit("; then report")).alias("q"))
    return rows.select("item_id", F.array_join(T.literal_facets(F.col("q")), "|").alias("facets"))


@query("fn_relative_path", "SELECT page_id, CASE CAST(page_id % 6 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'a/b/' || page_id WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN '.' ELSE 'x/' || page_id END AS path FROM pages")
def _(t):
    k = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("/etc/"), k)).when(F.col("page_id") % 6 == 1, F.concat(F.lit("a\\b\\"), k)).when(F.col("page_id") % 6 == 2, F.concat(F.lit("a/../"), k)).when(F.col("page_id") % 6 == 3, F.concat(F.lit("C:\\"), k)).when(F.col("page_id") % 6 == 4, "./").otherwise(F.concat(F.lit("./x//"), k))
    return t.pages.select("page_id", T.relative_path(raw).alias("path"))


@query("fn_redacted", "SELECT conv_id, turn, 'Authorization: Bearer [REDACTED] and [REDACTED] for [REDACTED]' AS shown FROM conversations")
def _(t):
    said = F.concat(F.lit("Authorization: bearer abc"), "conv_id", F.lit(" and sk-abcdefghijkl"), "turn", F.lit(" for hunter2"))
    return t.conversations.select("conv_id", "turn", T.redacted(said, ("hunter2",)).alias("shown"))


@query("fn_declared_substance", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 1.0::DOUBLE WHEN doc_id % 2 = 1 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS substance FROM documents")
def _(t):
    intent = F.when(F.col("doc_id") % 3 == 0, "the Schema of it").otherwise("how it works")
    kind = F.when(F.col("doc_id") % 2 == 1, "interface").otherwise("function")
    return t.documents.select("doc_id", T.substance_for(intent, F.lit("implementation"), kind, F.lit("a = 1\nb = 2")).alias("substance"))


@query("status_listing", """
WITH f AS (SELECT 'd/' || doc_id AS path, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'excluded' WHEN 1 THEN 'pending' WHEN 2 THEN 'deleted' ELSE 'indexed' END AS status FROM documents)
SELECT path, status FROM f ORDER BY path LIMIT 60""")
def _(t):
    """Two pages of a listing, the second by the cursor of the first."""
    rows = t.documents.select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 4).cast("int").alias("k"))
    found = rows.where("k = 1 or k = 3").select("path", "sha256")
    published = rows.where("k > 0").select("path", F.when(F.col("k") == 1, "old").otherwise(F.col("sha256")).alias("sha256"))
    listed = coverage.statuses(found, published, rows.where("k = 0").select("path", F.lit("binary-content").alias("reason")))
    first, cursor = coverage.page(listed, "g1", "d", 30)
    return first.unionByName(coverage.page(listed, "g1", "d", 30, cursor)[0]).select("path", "status")


@query("status_histogram", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'excluded' ELSE 'indexed' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'binary-content' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2")
def _(t):
    rows = t.documents.select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 4).cast("int").alias("k"))
    kept = rows.where("k > 0").select("path", "sha256")
    return coverage.histogram(coverage.statuses(kept, kept, rows.where("k = 0").select("path", F.lit("binary-content").alias("reason"))))


@query("status_why_excluded", f"WITH s AS (SELECT page_id, {S.PAGE_PATH} AS path FROM pages) SELECT page_id, CASE WHEN path LIKE '%node_modules/%' OR path LIKE '%/build/%' THEN 'dependency-or-build-directory' WHEN path LIKE 'docs/%' THEN 'configured-exclusion' WHEN path LIKE '%.min.js' THEN 'generated-or-non-source-name' END AS reason FROM s")
def _(t):
    return t.pages.select("page_id", coverage.why_excluded(F.expr(S.PAGE_PATH), ("docs/*",)).alias("reason"))
