"""Scores of rendered evidence against gold spans, and summaries over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def parsed(contexts: DataFrame) -> DataFrame:
    """(rid, path, line, text) of rendered contexts (rid, context): a header line applies to the numbered lines after it."""
    rows = contexts.select("rid", F.posexplode(T.physical_lines(F.col("context"))).alias("at", "row"))
    numbered = F.col("row").rlike(r"^[0-9]+\t")
    head = F.when(~numbered, F.col("row"))
    carried = rows.withColumn("path", F.last(head, ignorenulls=True).over(W.partitionBy("rid").orderBy("at")))
    return carried.where(numbered).select("rid", "path", F.regexp_extract("row", r"^([0-9]+)\t", 1).cast("int").alias("line"), F.regexp_replace("row", r"^[0-9]+\t", "").alias("text"))


def verified(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """Parsed lines with ``valid``: whether the source has exactly this text on this line."""
    known = sources.select("path", F.posexplode(T.physical_lines(F.col("text"))).alias("at", "truth")).select("path", (F.col("at") + 1).alias("line"), "truth")
    return lines.join(known, ["path", "line"], "left").withColumn("valid", F.coalesce(F.col("text") == F.col("truth"), F.lit(False))).drop("truth")


def coverage(gold: DataFrame, lines: DataFrame) -> DataFrame:
    """(rid, units, covered): a unit of gold (rid, unit, alternative, path, line) is covered if all lines of an alternative are there."""
    have = lines.where("valid").select("rid", "path", "line").distinct().withColumn("there", F.lit(True))
    met = gold.join(have, ["rid", "path", "line"], "left")
    alternatives = met.groupBy("rid", "unit", "alternative").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("whole"))
    units = alternatives.groupBy("rid", "unit").agg(F.bool_or("whole").alias("hit"))
    return units.groupBy("rid").agg(F.count(F.lit(1)).alias("units"), F.count_if("hit").alias("covered"))


def within_budget(lines: DataFrame, budget: int) -> DataFrame:
    """The leading whole lines (rid, at, cost) that fit the budget, with the running cost."""
    running = F.sum("cost").over(W.partitionBy("rid").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("spent", running).where(F.col("spent") <= budget)


def last_written(lines: DataFrame) -> DataFrame:
    """(path, line, text) of overlapping selections (path, line, text, at): what was written last to a line stays."""
    return lines.groupBy("path", "line").agg(F.max_by("text", "at").alias("text"))


def gold_faults(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """(task, unit, alternative, k, fault) of gold spans (task, unit, alternative, k, path, start, stop, quote, sha256) that do not hold.

    Faults: ``repeated`` (the same place in the answers twice), ``no-source``, ``bounds``, ``changed`` (the lines differ from the quote or its digest).
    """
    n = F.count(F.lit(1)).over(W.partitionBy("task", "unit", "alternative", "k"))
    met = spans.withColumn("copies", n).join(sources.select("path", T.physical_lines(F.col("text")).alias("lines")), "path", "left")
    actual = F.array_join(F.slice("lines", F.col("start"), F.col("stop") - F.col("start") + 1), "\n")
    fits = (F.col("start") >= 1) & (F.col("stop") >= F.col("start")) & (F.col("stop") <= F.size("lines"))
    fault = F.when(F.col("copies") > 1, "repeated").when(F.col("lines").isNull(), "no-source").when(~fits, "bounds")
    judged = met.withColumn("fault", fault)
    same = F.when(F.col("fault").isNull(), (actual == F.col("quote")) & (F.sha2(actual, 256) == F.col("sha256")))
    return judged.withColumn("fault", F.coalesce("fault", F.when(~same, "changed"))).where("fault is not null").select("task", "unit", "alternative", "k", "fault").distinct()


#: bounds of an answer that cites evidence
MAX_QUOTE_LINES, MAX_EVIDENCE, MAX_ANSWER = 40, 8, 16_000


def anchor_score(evidence: DataFrame, anchors: DataFrame, sources: DataFrame, sizes: DataFrame) -> DataFrame:
    """(task, valid, invalid, units, covered, in_budget) of cited evidence.

    ``evidence`` is (task, path, start, stop, quote): valid if the quote is the whole range of at most
    ``MAX_QUOTE_LINES`` lines, but for white space around it. ``anchors`` are (task, unit, path, anchor): a
    unit is covered if each of its anchors stands in valid evidence from its path. ``sizes`` is
    (task, chars) of the whole answer; over ``MAX_ANSWER`` characters or ``MAX_EVIDENCE`` citations nothing counts as covered.
    """
    blank = " \t\n\r\f\x0b"
    met = evidence.join(sources.select("path", F.split("text", "\n").alias("lines")), "path", "left")
    fits = (F.col("start") >= 1) & (F.col("stop") >= F.col("start")) & (F.col("stop") <= F.size("lines")) & (F.col("stop") - F.col("start") < MAX_QUOTE_LINES)
    text = F.when(F.coalesce(fits, F.lit(False)), F.array_join(F.slice("lines", F.col("start"), F.col("stop") - F.col("start") + 1), "\n"))
    trimmed = lambda c: F.btrim(c, F.lit(blank))
    judged = met.select("task", "path", text.alias("text"), F.coalesce((trimmed(text) == trimmed(F.col("quote"))) & (trimmed(F.col("quote")) != ""), F.lit(False)).alias("valid"))
    counts = judged.groupBy("task").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
    hit = anchors.join(judged.where("valid").select("task", "path", "text"), ["task", "path"], "left").groupBy("task", "unit", "path", "anchor").agg(F.max(F.coalesce(F.contains("text", "anchor"), F.lit(False))).alias("found"))
    units = hit.groupBy("task", "unit").agg(F.bool_and("found").alias("covered")).groupBy("task").agg(F.count(F.lit(1)).alias("units"), F.count_if("covered").alias("covered"))
    out = units.join(counts, "task", "left").join(sizes, "task", "left").na.fill(0, ["valid", "invalid", "chars"])
    budget = (F.col("chars") <= MAX_ANSWER) & (F.col("valid") + F.col("invalid") <= MAX_EVIDENCE)
    return out.select("task", "valid", "invalid", "units", F.when(budget, F.col("covered")).otherwise(F.lit(0)).alias("covered"), budget.alias("in_budget"))


def islands(lines: DataFrame) -> DataFrame:
    """(path, start, stop, n): runs of neighbouring line numbers of distinct (path, line)."""
    order = W.partitionBy("path").orderBy("line")
    flagged = lines.select("path", "line").distinct().withColumn("new", F.when(F.col("line") - F.lag("line").over(order) == 1, 0).otherwise(1))
    return flagged.withColumn("run", F.sum("new").over(order)).groupBy("path", "run").agg(F.min("line").alias("start"), F.max("line").alias("stop"), F.count(F.lit(1)).alias("n")).drop("run")
