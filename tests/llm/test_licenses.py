import duckdb
import numpy as np
import pandas as pd

from fathomline.llm import licenses
from fathomline.llm.entry import op10_license_scan
from fathomline.llm.license_texts import TEMPLATES


def wanted(rows, templates=None):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    return sorted(str(tuple(r)) for r in con.sql(licenses.sql(templates)).fetchall())


def found(spark, rows, templates=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as w", "'x' as template", "2 as n")
    return sorted(str(tuple(r)) for r in licenses.scan(docs, templates).collect())


def _noise(rng, n):
    return " ".join("w%d" % k for k in rng.integers(0, 5000, size=n))


def test_planted_copies_match_sql(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, (name, text) in enumerate(sorted(TEMPLATES.items()) * 4):
        words = text.split()
        for at in rng.choice(len(words), size=len(words) // 40 * (k // len(TEMPLATES)), replace=False):
            words[at] = "changed"
        if k % 3 == 1 and len(words) > 60:
            words = words[: len(words) // 2]
        rows.append((k, _noise(rng, int(rng.integers(0, 300))) + "\n" + " ".join(words) + ".\n" + _noise(rng, int(rng.integers(0, 300)))))
    rows += [(900, None), (901, ""), (902, " .,-"), (903, "short text"), (904, _noise(rng, 4000)), (None, TEMPLATES["mit"]), (905, "RELEASED under -- the mit\n\nlicense"), (905, "nothing here at all of note"), (906, (TEMPLATES["isc"] + " ") * 30), (906, TEMPLATES["isc"])]
    got = found(spark, rows)
    assert got == wanted(rows)
    assert sum("'mit'" in x for x in got) >= 3


def test_short_and_missing_templates(spark):
    templates = {"tiny": "all rights reserved", "none": "--", "five": "one two three four five"}
    rows = [(1, "All rights reserved."), (2, "one two three four five six"), (3, "all rights reserved now and then")]
    assert found(spark, rows, templates) == wanted(rows, templates)
    assert found(spark, rows, {"none": "..."}) == []
    assert found(spark, []) == []


def test_slices_of_templates_give_the_same(spark, monkeypatch):
    rows = [(k, f"before {text} after") for k, text in enumerate(sorted(TEMPLATES.values()))]
    whole = found(spark, rows)
    monkeypatch.setattr(licenses, "SLICE_SHINGLES", 150)
    assert found(spark, rows) == whole and len(whole) >= len(TEMPLATES)


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(str(r) for r in con.sql(licenses.sql()).fetchall())
    got = sorted(str(tuple(r)) for r in op10_license_scan(spark, sf).collect())
    assert got == want and got


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
