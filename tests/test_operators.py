"""Properties and scenarios of the operators that SQL cannot express."""

import json
import subprocess

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import packing
from fathomline.sources import store, units
from fathomline.streaming import live

UNITS = st.lists(st.tuples(st.integers(0, 400), st.sampled_from("abcde"), st.integers(1, 900), st.sampled_from("xy"), st.floats(0, 1), st.lists(st.floats(0, 1), min_size=2, max_size=2)), min_size=1, max_size=25, unique_by=lambda u: u[0])


@settings(max_examples=60, deadline=None)
@given(UNITS, st.integers(50, 3000), st.sampled_from(sorted(packing.PRESETS)))
def test_packers_keep_the_budget_and_repeat_nothing(rows, budget, preset):
    chosen = packing.select(rows, budget, packing.PRESETS[preset])
    assert len({i for i, _, _ in chosen}) == len(chosen)
    assert sum(rows[i][2] for i, _, _ in chosen) == (chosen[-1][2] if chosen else 0) <= budget


def test_serial_packer_follows_its_formula():
    rows = [(1, "a", 300, "p", 0.9, [0.9, 0.1]), (2, "b", 300, "p", 0.8, [0.8, 0.2]), (3, "c", 300, "q", 0.5, [0.0, 0.9]), (4, "d", 300, "q", 0.0, [0.0, 0.01])]
    # after 1, the first facet is covered and 3 gains more than 2: .7 * (.9 / 1.1) / 2 + .15 against .7 * (.8 / 1.9 + .2 / 1.1) / 2 + .24
    assert [rows[i][0] for i, _, _ in packing.select(rows, 1200, packing.PRESETS["serial"])] == [1, 2, 3]
    assert [rows[i][0] for i, _, _ in packing.select(rows, 300, packing.PRESETS["serial"])] == [1]


def _unit(uid, symbol="s", path="p", cost=100, role="implementation", intent=0.9, worth=(0.5, 0.5), callees=()):
    return packing.Unit(uid, symbol, path, cost, role, intent, worth, frozenset(callees))


def test_evidence_takes_helpers_parts_and_related_tests():
    rows = [_unit(1, "f", callees=[2]), _unit(2, "g", cost=200), _unit(3, "f", worth=(0.1, 0.1)), _unit(4, "t1", "q", role="test", worth=(0.4, 0.4)), _unit(5, "t2", "q", role="test", worth=(0.3, 0.3), callees=[1]), _unit(6, "z", worth=(0.0, 0.0))]
    chosen = packing.Evidence(rows, 4000, tests=True).run()
    assert [i for i, _ in chosen] == [1, 2, 3, 5, 4]
    assert dict(chosen)[5] == "support" and dict(chosen)[4] == "fill"
    small = packing.Evidence(rows, 130).run()
    assert small == [(1, "primary")] or small == [(1, "fill")]


def test_evidence_spreads_over_facets_and_paths():
    rows = [_unit(k, f"s{k}", "crowd", 300, worth=(0.5, 0.9 - k / 100, 0.1)) for k in range(1, 8)] + [_unit(20, "other", "side", 300, worth=(0.5, 0.1, 0.8))]
    chosen = [i for i, _ in packing.Evidence(rows, 1000).run()]
    assert chosen[:2] == [1, 20]
    assert sum(u.cost for u in rows if u.uid in chosen) <= 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from("abc"), st.integers(1, 900), st.sampled_from(["test", "implementation"]), st.floats(0, 1), st.sets(st.integers(0, 30), max_size=4)), unique_by=lambda u: u[0], max_size=20), st.integers(1, 20_000))
def test_evidence_keeps_the_budget(rows, budget):
    units_ = [_unit(u, s, s, c, r, w, (w, 1 - w), x) for u, s, c, r, w, x in rows]
    chosen = packing.Evidence(units_, budget, tests=True).run()
    cost = {u.uid: u.cost for u in units_}
    assert len({i for i, _ in chosen}) == len(chosen) and sum(cost[i] for i, _ in chosen) <= budget


LINES = st.lists(st.sampled_from(["", "  ", "x", "word " * 20, "y" * 700, "z" * 2500]), max_size=200)


@settings(max_examples=80, deadline=None)
@given(LINES)
def test_chunks_cover_every_line_once_within_the_limits(lines):
    found = units.chunks(lines)
    assert [k for a, b in found for k in range(a, b)] == list(range(len(lines)))
    for a, b in found:
        assert b - a <= units.MAX_LINES and (b - a == 1 or sum(len(x) + 1 for x in lines[a:b]) <= units.MAX_CHARS)


PYTHON = "import os\n\n\n@wrap\ndef f(a):\n    return os.path.join(a)\n\n\nclass C:\n    x = 1\n\n    def m(self):\n        return f(self)\n"


def test_python_units_are_lossless_and_named(spark):
    rows = [("a.py", PYTHON, "python"), ("bad.py", "def (:\n  x\n", "python"), ("b.txt", "one\r\ntwo\rthree\n\n", "text"), ("none", None, "text"), ("empty", "", "text")]
    files = spark.createDataFrame(rows, "path string, text string, language string")
    made = units.extract(files)
    assert units.violations(made, files).count() == 0
    kinds = {(r["path"], r["kind"], r["symbol"], r["owner"]) for r in made.collect()}
    assert ("a.py", "function", "a.py.f", None) in kinds and ("a.py", "method", "a.py.C.m", "a.py.C") in kinds
    assert ("bad.py", "text", "text:bad.py:L1", None) in kinds
    called = {(r["line"], r["name"]) for r in units.calls(files).collect()}
    assert called == {(6, "os.path.join"), (13, "f")}
    ids = [r["uid"] for r in units.with_ids(made.select("path", "start")).collect()]
    assert sorted(ids) == list(range(made.count()))


def test_validator_names_faults(spark):
    files = spark.createDataFrame([("p", "a\nb\n\nc\n")], "path string, text string")
    made = spark.createDataFrame([("p", 1, "a\nX"), ("p", 2, "b"), ("p", 9, "z")], "path string, start int, text string")
    assert {(r["line"], r["fault"]) for r in units.violations(made, files).collect()} == {(2, "overlap"), (4, "uncovered"), (9, "outside")}


def test_snapshot_leaves_out_with_reasons(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "bom.txt": b"\xef\xbb\xbfhi\n", "node_modules/m.js": b"x", "uv.lock": b"x", ".env": b"x", "bin.dat": b"a\x00b", "bad.txt": b"\xff\xfe", "gen.go": b"// Code generated by x. DO NOT EDIT.\n", "skip/me.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.py")
    files, excluded = store.snapshot(spark, str(tmp_path), ("skip/*",))
    assert {(r["path"], r["text"], r["language"]) for r in files.collect()} == {("a.py", "x = 1\n", "python"), ("bom.txt", "hi\n", "text")}
    reasons = {r["path"]: r["reason"] for r in excluded.collect()}
    assert reasons == {"uv.lock": "generated-or-non-source-name", ".env": "local-environment", "bin.dat": "binary-content", "bad.txt": "non-utf8", "gen.go": "generated-header", "skip/me.txt": "configured"}


def test_git_listing_honours_ignores(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("ignored.txt\n")
    (tmp_path / "ignored.txt").write_text("x")
    (tmp_path / "seen.txt").write_text("x")
    assert store.listed(str(tmp_path)) == [".gitignore", "seen.txt"]


def test_store_appends_only_what_is_missing(spark, tmp_path):
    rows = lambda *ks: spark.createDataFrame([(k, k + "!") for k in ks], "key string, value string")
    path = str(tmp_path / "store")
    assert store.put_missing(path, rows("a", "b", "a")) == 2
    assert store.put_missing(path, rows("b", "c")) == 1
    assert store.put_missing(path, rows("c")) == 0
    kept = store.collect_garbage(spark.read.parquet(path), [rows("a"), rows("c", "z")])
    assert {r["key"] for r in kept.collect()} == {"a", "c"}


def test_versions_are_replaced_in_one_step(spark, tmp_path):
    first = store.publish(str(tmp_path), {"units": spark.range(3)}, {"identity": "one"})
    old = store.current(spark, str(tmp_path))[1]["units"]
    second = store.publish(str(tmp_path), {"units": spark.range(5)}, {"identity": "two"})
    info, tables = store.current(spark, str(tmp_path))
    assert first != second and info["identity"] == "two" and tables["units"].count() == 5 and old.count() == 3


def test_stream_keeps_the_latest_state_through_a_restart(spark, tmp_path):
    source, out = tmp_path / "changes", tmp_path / "states"
    schema = "path string, state string, ts timestamp, seq long"

    def publish(states, batch):
        states.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    def change(*rows):
        spark.createDataFrame([(p, s, n) for p, s, n in rows], "path string, state string, seq long").selectExpr("path", "state", "timestamp_seconds(seq) as ts", "seq").coalesce(1).write.mode("append").parquet(str(source))

    change(("a", "add", 1), ("b", "add", 2), ("a", "edit", 3))
    live.keep_current(live.watch(spark, str(source), schema), str(tmp_path / "cp"), publish).awaitTermination()
    change(("b", "delete", 4), ("c", "add", 5))
    live.keep_current(live.watch(spark, str(source), schema), str(tmp_path / "cp"), publish).awaitTermination()
    states = live.latest(spark.read.parquet(str(out)).withColumn("seq", F.unix_seconds("ts")))
    assert {(r["path"], r["state"]) for r in states.collect()} == {("a", "edit"), ("b", "delete"), ("c", "add")}


def test_plan_query_splits_only_actionable_clauses(spark):
    cases = ["How is a session restored and where is it saved", "When a tab closes, how is the draft kept; which file stores it", "short", "Validate the input: reject bad rows"]
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(cases)], "k int, q string").select("k", F.col("q"), T.facets(F.col("q")).alias("f")).orderBy("k").collect()
    assert [[x["question"] for x in r["f"]] for r in rows] == [["How is a session restored", "where is it saved"], ["how is the draft kept", "which file stores it"], ["short"], ["Validate the input", "reject bad rows"]]


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert json.loads(out.schema.json())["fields"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
