"""Queries on aggregates, windows, the live index, coverage and evaluation, and three extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate
from ..sources import shared, store
from ..streaming import live
from . import fragments as S
from .registry import Tables, query


@query("agg_language_histogram", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars < 100) AS degraded, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") < 100).alias("degraded"), F.sum("n_chars").cast("long").alias("chars"))


_STATES = ["click", "view", "purchase", "signup", "error", "unknown"]


@query("agg_status_pivot", "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{s}') AS n_{s}" for s in _STATES) + " FROM events GROUP BY user_id")
def _(t):
    wide = t.events.groupBy("user_id").pivot("event_type", _STATES).count().na.fill(0)
    return wide.select("user_id", *[F.col(s).alias(f"n_{s}") for s in _STATES])


@query("agg_store_usage", "SELECT user_id % 64 AS shard, count(*) AS entries, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, max(ts) AS used FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy((F.col("user_id") % 64).alias("shard")).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("props")).cast("long").alias("bytes"), F.max("ts").alias("used"))


@query("win_role_rank", "SELECT d.doc_id, quality, CAST(row_number() OVER (PARTITION BY lang, quality ORDER BY n_chars DESC, d.doc_id) - 1 AS INT) AS rank FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    met = t.documents.join(t.labels, "doc_id")
    return met.select("doc_id", "quality", (F.row_number().over(W.partitionBy("lang", "quality").orderBy(F.desc("n_chars"), "doc_id")) - 1).alias("rank"))


@query("win_prefix_budget", f"""
WITH l AS (SELECT doc_id AS rid, unnest(range(0, len(l))) AS pos, unnest(l) AS body FROM (SELECT doc_id, {S.lines('text')} AS l FROM documents)),
s AS (SELECT rid, pos, sum({S.tokens('body')} + 1) OVER (PARTITION BY rid ORDER BY pos) AS spent FROM l)
SELECT rid, count(*) AS kept, CAST(max(spent) AS BIGINT) AS spent FROM s WHERE spent <= 256 GROUP BY rid""")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("rid"), F.posexplode(T.physical_lines(F.col("text"))).alias("at", "row"))
    kept = evaluate.within_budget(rows.select("rid", "at", (T.tokens(F.col("row")) + 1).cast("long").alias("cost")), 256)
    return kept.groupBy("rid").agg(F.count(F.lit(1)).alias("kept"), F.max("spent").alias("spent"))


@query("win_lru_eviction", """
WITH s AS (SELECT user_id AS shard, max(ts) AS used, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY 1), p AS (SELECT * FROM s WHERE shard % 10 <> 0),
r AS (SELECT *, sum(bytes) OVER (ORDER BY used DESC, shard) AS held FROM p) SELECT shard, held > (SELECT sum(bytes) / 2 FROM p) AS evicted FROM r""")
def _(t):
    # one row for each shard of the store, so the total order is over the store's catalogue and not over its rows
    shards = t.events.groupBy(F.col("user_id").alias("shard")).agg(F.max("ts").alias("used"), F.sum(F.octet_length("props")).cast("long").alias("bytes")).where("shard % 10 <> 0")
    held = F.sum("bytes").over(W.orderBy(F.desc("used"), "shard").rowsBetween(W.unboundedPreceding, 0))
    return shards.withColumn("held", held).crossJoin(F.broadcast(shards.agg((F.sum("bytes") / 2).alias("limit")))).select("shard", (F.col("held") > F.col("limit")).alias("evicted"))


@query("win_pagination", "SELECT url, CAST(row_number() OVER (ORDER BY url, page_id) - 1 AS INT) AS place FROM pages ORDER BY url, page_id LIMIT 50 OFFSET 25")
def _(t):
    page = t.pages.select("url", "page_id").orderBy("url", "page_id").limit(75)
    return page.withColumn("place", F.row_number().over(W.orderBy("url", "page_id")) - 1).where("place >= 25").select("url", "place")


@query("score_usage_totals", "SELECT event_type, CASE WHEN count(*) = count(v) THEN round(sum(v), 3) END AS total FROM (SELECT event_type, CASE WHEN value >= 0 AND user_id % 50 <> 7 OR event_type <> 'view' THEN value END AS v FROM events) GROUP BY 1")
def _(t):
    v = F.when(((F.col("value") >= 0) & (F.col("user_id") % 50 != 7)) | (F.col("event_type") != "view"), F.col("value"))
    return t.events.withColumn("v", v).groupBy("event_type").agg(F.when(F.count(F.lit(1)) == F.count("v"), F.round(F.sum("v"), 3)).alias("total"))


def _changes(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("path"), F.col("event_type").alias("state"), "ts", F.col("event_id").alias("seq"))


@query("live_latest_state", "SELECT user_id AS path, arg_max(event_type, {'t': ts, 'e': event_id}) AS state, max(ts) AS ts FROM events GROUP BY 1")
def _(t):
    return live.latest(_changes(t))


@query("live_debounce_sessions", """
WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT user_id AS path, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM r GROUP BY user_id, run""")
def _(t):
    return live.debounced(_changes(t), "6 hours")


_BEFORE = "SELECT doc_id AS path, sha256(text) AS sha256 FROM documents WHERE source <> 'src3'"
_AFTER = "SELECT doc_id AS path, sha256(CASE WHEN source = 'src1' THEN text || 'x' ELSE text END) AS sha256 FROM documents WHERE source <> 'src2'"


def _manifests(t: Tables) -> tuple[DataFrame, DataFrame]:
    edited = F.when(F.col("source") == "src1", F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    before = t.documents.where("source <> 'src3'").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return before, t.documents.where("source <> 'src2'").select(F.col("doc_id").alias("path"), F.sha2(edited, 256).alias("sha256"))


@query("live_generation_diff", f"""
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' WHEN b.sha256 <> a.sha256 THEN 'changed' ELSE 'same' END AS change
FROM ({_BEFORE}) b FULL JOIN ({_AFTER}) a ON a.path = b.path""")
def _(t):
    return live.diff(*_manifests(t))


@query("live_poll_stream", "SELECT user_id AS path, arg_max(event_type, {'t': ts, 's': event_type}) AS state, max(ts) AS ts FROM events GROUP BY 1")
def _(t):
    """The change files of a folder as a stream, drained into published versions of the latest state of each path."""
    import uuid

    from pyspark.sql.types import StructType

    spark = t.spark
    root = f"{shared.checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    schema = StructType([f for f in t.events.schema if f.name in ("event_id", "user_id", "event_type", "ts")])
    # a glob of one file: the folder holds the other tables too
    stream = live.watch(spark, f"{t.sf_dir}/events.parquet*", schema)
    # the state itself breaks ties of one instant
    changes = stream.select(F.col("user_id").alias("path"), F.col("event_type").alias("state"), "ts", F.col("event_type").alias("seq"))
    live.keep_current(changes, f"{root}/checkpoint", live.publish_states(f"{root}/states")).awaitTermination()
    return store.current(spark, f"{root}/states")[1]["states"]


@query("live_garbage", "SELECT DISTINCT sha256(text) AS key FROM documents WHERE source IN ('src1', 'src2')")
def _(t):
    kept = t.documents.select("source", F.sha2("text", 256).alias("key"))
    return store.collect_garbage(kept.select("key").distinct(), [kept.where("source = 'src1'"), kept.where("source = 'src2'")])


@query("status_coverage", f"""
WITH s AS (SELECT page_id, {S.PAGE_PATH} AS path FROM pages), e AS (SELECT DISTINCT user_id FROM events)
SELECT page_id, CASE WHEN path LIKE '%node_modules/%' OR path LIKE '%/build/%' OR path LIKE '%.min.js' THEN 'excluded' WHEN e.user_id IS NOT NULL THEN 'indexed' ELSE 'pending' END AS status
FROM s LEFT JOIN e ON e.user_id = s.page_id""")
def _(t):
    seen = t.events.select(F.col("user_id").alias("page_id")).distinct().withColumn("indexed", F.lit(True))
    met = t.pages.select("page_id", F.expr(S.PAGE_PATH).alias("path")).join(seen, "page_id", "left")
    return met.select("page_id", F.when(T.path_exclusion(F.col("path")).isNotNull(), "excluded").when(F.col("indexed"), "indexed").otherwise("pending").alias("status"))


_CONTEXTS = f"""src AS (SELECT doc_id, 'd/' || doc_id AS path, {S.lines('text')} AS l FROM documents), line AS (SELECT doc_id, path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM src),
seen AS (SELECT doc_id, path, line, CASE WHEN doc_id % 5 = 0 AND line = 2 THEN text || '!' ELSE text END AS text FROM line)"""


def _contexts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Rendered documents, one in five with a changed line, and their sources."""
    lines = T.physical_lines(F.col("text"))
    sources = t.documents.select(F.col("doc_id").alias("rid"), F.concat(F.lit("d/"), "doc_id").alias("path"), "text")
    head = F.transform(lines, lambda x, i: F.when((F.col("doc_id") % 5 == 0) & (i == 1), F.concat(x, F.lit("!"))).otherwise(x))
    contexts = t.documents.select(F.col("doc_id").alias("rid"), F.concat_ws("\n", F.concat(F.lit("d/"), "doc_id"), F.array_join(F.transform(head, lambda x, i: F.concat_ws("\t", (i + 1).cast("string"), x)), "\n")).alias("context"))
    return contexts, sources


@query("eval_parse_verify", f"WITH {_CONTEXTS} SELECT doc_id AS rid, CAST(s.line AS INT) AS line, s.text = l.text AS valid FROM seen s JOIN line l USING (doc_id, line)")
def _(t):
    contexts, sources = _contexts(t)
    return evaluate.verified(evaluate.parsed(contexts), sources.drop("rid")).select("rid", "line", "valid")


_GOLD = "gold AS (SELECT doc_id AS rid, line // 3 AS unit, line % 2 AS alternative, path, line FROM line WHERE trim(text, ' ') <> '')"


@query("eval_coverage", f"""
WITH {_CONTEXTS}, {_GOLD}, ok AS (SELECT s.doc_id AS rid, s.line FROM seen s JOIN line l USING (doc_id, line) WHERE s.text = l.text),
a AS (SELECT g.rid, unit, alternative, bool_and(ok.line IS NOT NULL) AS whole FROM gold g LEFT JOIN ok ON ok.rid = g.rid AND ok.line = g.line GROUP BY 1, 2, 3), u AS (SELECT rid, unit, bool_or(whole) AS hit FROM a GROUP BY 1, 2)
SELECT rid, count(*) AS units, count(*) FILTER (WHERE hit) AS covered FROM u GROUP BY rid""")
def _(t):
    return evaluate.coverage(_gold(t), _verified(t))


def _verified(t: Tables) -> DataFrame:
    contexts, sources = _contexts(t)
    return evaluate.verified(evaluate.parsed(contexts), sources.drop("rid"))


def _gold(t: Tables) -> DataFrame:
    lines = _contexts(t)[1].select("rid", "path", F.posexplode(T.physical_lines(F.col("text"))).alias("k", "row")).withColumn("line", F.col("k") + 1)
    return lines.where(F.trim("row") != "").select("rid", F.floor(F.col("line") / 3).alias("unit"), (F.col("line") % 2).alias("alternative"), "path", "line")


@query("eval_gold_validate", "SELECT item_id, doc_id, CAST(instr(d.text, b.text) AS INT) AS at FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def _(t):
    """Gold passages that a source holds verbatim; documents and passages meet on the passages' hashed words, not as all pairs."""
    size = 8
    words = lambda x: F.split(x, " ")
    item = t.benchmark.select("item_id", F.col("text").alias("passage"), F.array_join(F.slice(words("text"), 2, size), " ").alias("key"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1)), lambda i: F.array_join(F.slice("w", i, size), " "))
    held = t.documents.select("doc_id", words("text").alias("w"), "text").select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
    pairs = held.join(item.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    met = pairs.join(item.select("item_id", "passage"), "item_id").join(t.documents.select("doc_id", "text"), "doc_id")
    return met.where(F.contains("text", "passage")).select("item_id", "doc_id", F.position("passage", "text").alias("at"))


@query("eval_macro_summary", "SELECT source, lang, round(avg(quality), 6) AS coverage, count(*) AS runs, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS complete FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def _(t):
    met = t.documents.join(t.labels, "doc_id")
    return met.groupBy("source", "lang").agg(F.round(F.avg("quality"), 6).alias("coverage"), F.count(F.lit(1)).alias("runs"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("complete"))


@query("eval_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@query("eval_paired_delta", """
WITH m AS (SELECT source, lang, avg(quality)::DOUBLE AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), p AS (SELECT a.source, b.lang, a.c - b.c AS d FROM m a JOIN m b ON a.source = b.source AND a.lang = 'en' AND b.lang <> 'en')
SELECT lang, count(*) FILTER (WHERE d > 1e-10) AS wins, count(*) FILTER (WHERE abs(d) <= 1e-10) AS ties, count(*) FILTER (WHERE d < -1e-10) AS losses, round(avg(d), 6) AS delta FROM p GROUP BY lang""")
def _(t):
    mean = t.documents.join(t.labels, "doc_id").groupBy("source", "lang").agg(F.avg("quality").alias("c"))
    en = mean.where("lang = 'en'").select("source", F.col("c").alias("e"))
    paired = mean.where("lang <> 'en'").join(en, "source").withColumn("d", F.col("e") - F.col("c"))
    return paired.groupBy("lang").agg(F.count_if(F.col("d") > 1e-10).alias("wins"), F.count_if(F.abs("d") <= 1e-10).alias("ties"), F.count_if(F.col("d") < -1e-10).alias("losses"), F.round(F.avg("d"), 6).alias("delta"))


@query("eval_miss_taxonomy", f"""
WITH {_CONTEXTS}, {_GOLD}, spent AS (SELECT doc_id, line, sum({S.tokens('text')} + 1) OVER (PARTITION BY doc_id ORDER BY line) AS spent FROM seen),
ok AS (SELECT s.doc_id AS rid, s.line, spent FROM seen s JOIN line l USING (doc_id, line) JOIN spent USING (doc_id, line) WHERE s.text = l.text),
a AS (SELECT g.rid, unit, alternative, bool_and(ok.line IS NOT NULL) AS raw, bool_and(ok.line IS NOT NULL AND coalesce(spent, 0) <= 256) AS cut, bool_or(ok.line IS NOT NULL) AS part FROM gold g LEFT JOIN ok ON ok.rid = g.rid AND ok.line = g.line GROUP BY 1, 2, 3),
u AS (SELECT rid, unit, bool_or(raw) AS raw, bool_or(cut) AS cut, bool_or(part) AS part FROM a GROUP BY 1, 2)
SELECT CASE WHEN cut THEN 'covered' WHEN raw THEN 'lost-to-budget' WHEN part THEN 'incomplete-in-raw' ELSE 'absent-from-raw' END AS kind, count(*) AS n FROM u GROUP BY 1""")
def _(t):
    """Gold that is covered within 256 tokens, lost to that budget, incomplete or absent."""
    spent = F.sum(T.tokens(F.col("text")) + 1).over(W.partitionBy("rid").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    have = _verified(t).withColumn("spent", spent).where("valid").select("rid", "path", "line", "spent").withColumn("there", F.lit(True))
    met = _gold(t).join(have, ["rid", "path", "line"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    whole = met.groupBy("rid", "unit", "alternative").agg(F.bool_and("there").alias("raw"), F.bool_and(F.col("there") & (F.coalesce("spent", F.lit(0)) <= 256)).alias("cut"), F.bool_or("there").alias("part"))
    units = whole.groupBy("rid", "unit").agg(*[F.bool_or(c).alias(c) for c in ("raw", "cut", "part")])
    kind = F.when(F.col("cut"), "covered").when(F.col("raw"), "lost-to-budget").when(F.col("part"), "incomplete-in-raw").otherwise("absent-from-raw")
    return units.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("ext_cube", "SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def _(t):
    return t.documents.cube("lang", "source").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n")


@query("ext_asof", "SELECT a.event_id, arg_max(b.event_id, {'t': b.ts, 'e': b.event_id}) AS previous FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND (b.ts < a.ts OR b.ts = a.ts AND b.event_id <= a.event_id) GROUP BY 1")
def _(t):
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(mark, ignorenulls=True).over(order).alias("previous"))


@query("ext_watermark", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    """Days counted as a stream in append mode: a day is written once when the watermark has passed it; a last event far ahead closes the last day."""
    import uuid

    spark = t.spark
    root = f"{shared.checkpoint_dir(spark)}/days-{uuid.uuid4().hex}"
    schema = "ts timestamp, event_type string"
    seen = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    store.put(seen, f"{root}/in/1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/in")
    days = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")

    def drain() -> None:
        days.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    drain()
    store.put(seen.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts")).withColumn("event_type", F.lit("")), f"{root}/in/2")
    drain()
    out = spark.read.schema("day timestamp, event_type string, n bigint").parquet(f"{root}/out").where("event_type <> ''")
    return out.select(F.col("day").cast(dict(t.events.dtypes)["ts"]).alias("day"), "event_type", "n")
