"""Relations, adapters, bundles, the index, backends, stores and the live helpers."""

import random
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline import index
from fathomline.operators import coverage, evaluate, graph, scoring
from fathomline.sources import backends, braces, relations, store, units
from fathomline.streaming import live


def found(text, path="pkg/a.py"):
    return {(line, kind, target) for _, line, kind, target in relations.links(path, text) if kind in ("calls", "inherits", "doc_reference")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("from .b import run as go\ngo()\n", {(2, "calls", "pkg.b.run")}),
        ("import x.y as z\nz.f()\n", {(2, "calls", "x.y.f")}),
        ("import x.y\nx.y.f()\n", {(2, "calls", "x.y.f")}),
        ("from .... import b\nb()\n", set()),
        ("from m import *\nf()\n", set()),
        ("from m import f\nf = 1\nf()\n", set()),
        ("from m import f\ndef g(f):\n    f()\n", set()),
        ("from m import f\ndef g():\n    f()\n    f = 1\n", set()),
        ("from m import f\n[f() for f in x]\nf()\n", {(3, "calls", "m.f")}),
        ("from m import f\n(lambda f: f())(1)\n", set()),
        ("if x:\n    from m import f\n    f()\nf()\n", {(3, "calls", "m.f")}),
        ("try:\n    from m import f\nexcept E:\n    f = None\nf()\n", set()),
        ("class A:\n    def f(self):\n        self.g()\n    def g(this):\n        this.f()\n", {(3, "calls", "pkg.a.A.g")}),
        ("from m import f\nclass A:\n    f = 1\n    def g(self):\n        f()\n", {(5, "calls", "m.f")}),
        ("from m import B\nclass A(B):\n    pass\nclass C(A, D):\n    pass\n", {(2, "inherits", "m.B"), (4, "inherits", "pkg.a.A"), (4, "inherits", "pkg.a.D")}),
        ("def f():\n    ''':func:`~m.g` and :meth:`h`'''\n", {(2, "doc_reference", "m.g"), (2, "doc_reference", "h")}),
        ("def f():\n    global g\n    g = 1\ndef g(): pass\ng()\n", set()),
        ("from m import f\ndef g(a=f()):\n    pass\n", {(2, "calls", "m.f")}),
        ("broken (", set()),
    ],
)
def test_scopes(text, want):
    assert found(text) == want


def test_package_modules():
    assert relations.module_name("a/b/__init__.py") == "a.b" and relations.module_name("c.py") == "c"
    assert found("from . import x\nx.f()\n", "pkg/__init__.py") == {(2, "calls", "pkg.x.f")}


def test_longest_module_prefix(spark):
    names = spark.createDataFrame([(x,) for x in ("pkg.a.f", "a.f", "dup.g", "pkg.a.K.m", "none.x", "src.pkg.a.f")], "name string")
    modules = spark.createDataFrame([("src.pkg.a",), ("x.dup",), ("y.dup",)], "module string")
    got = {r.name: (r.module, r.rest) for r in graph.qualified(names, modules).collect()}
    assert got == {"pkg.a.f": ("src.pkg.a", "f"), "a.f": ("src.pkg.a", "f"), "pkg.a.K.m": ("src.pkg.a", "K.m"), "src.pkg.a.f": ("src.pkg.a", "f")}


GO = 'package m\n\n// F { is not code\ntype T struct {\n\tx int // }\n}\n\nfunc (t *T) Get(a string) int {\n\tp("{", `}\\`)\n\treturn help(a)\n}\n'
TS = "import { run as go, C } from './b.js'\nexport class K extends C {\n  constructor(x) {\n    if (/[/}]/.test(x)) { go(x) }\n  }\n}\nexport const f = (a) => {\n  return `${a} }`\n}\ninterface P { a: string }\ntype Q = string\n"


def test_brace_units():
    got = [(u[1], u[2], u[4], u[5]) for u in braces.brace_units("go")("m/a.go", GO)]
    assert got == [("m/a.go", "module", 1, 3), ("m/a.go.T", "type", 4, 6), ("m/a.go.T.Get", "method", 8, 11)]
    got = [(u[1], u[2], u[4], u[5]) for u in braces.brace_units("typescript")("w/a.ts", TS)]
    assert got == [("w/a.ts", "module", 1, 1), ("w/a.ts.K", "class-body", 2, 2), ("w/a.ts.K.constructor", "method", 3, 5), ("w/a.ts.K", "class-body", 6, 6), ("w/a.ts.f", "function", 7, 9), ("w/a.ts.P", "interface", 10, 10), ("w/a.ts.Q", "type-alias", 11, 11)]
    assert {u[2] for u in braces.brace_units("go")("m/a.go", "func f() {")} == {"text"}
    assert ("w/a.ts", 4, "calls", "w/b#run") in braces.brace_links("w/a.ts", TS, "typescript") and ("w/a.ts", 2, "inherits", "w/b#C") in braces.brace_links("w/a.ts", TS, "typescript")


def test_units_cover_all_lines_and_only_changes_are_extracted(spark):
    rows = [("m/a.go", GO, "go", "1"), ("w/a.ts", TS, "typescript", "2"), ("x.go", "func f() {", "go", "3"), ("p.py", "x = 1\n", "python", "4")]
    files = spark.createDataFrame(rows, "path string, text string, language string, sha256 string")
    made = units.extract(files)
    assert units.violations(made, files).collect() == []
    assert [r.path for r in units.fell_back(files, made).collect()] == ["x.go"]
    before = units.extract_changed(files, made.withColumn("fingerprint", F.lit("")))
    after = units.extract_changed(files.withColumn("sha256", F.when(F.col("path") == "p.py", "5").otherwise(F.col("sha256"))), before)
    assert sorted(map(str, after.drop("fingerprint").collect())) == sorted(map(str, made.select(*after.drop("fingerprint").columns).collect()))


def test_owner_closure_climbs_long_chains_and_stops_in_circles(spark):
    rows = [(f"s{k}", f"s{k - 1}" if k else None, True) for k in range(40)] + [("a", "b", True), ("b", "c", True), ("c", "a", True), ("d", "a", True), ("m", "top", True), ("top", None, False)]
    got = {r.symbol: r.root for r in graph.owner_closure(spark.createDataFrame(rows, "symbol string, owner string, callable boolean")).collect()}
    assert all(got[f"s{k}"] == "s0" for k in range(40))
    assert got["m"] == "m" and got["top"] == "top"

    def climb(s):
        up, seen = {r[0]: r[1] for r in rows}, [s]
        while up[seen[-1]] not in seen:
            seen.append(up[seen[-1]])
        return seen[-1]

    assert {s: got[s] for s in "abcd"} == {s: climb(s) for s in "abcd"}


def brute_bundles(rows, calls):
    root = {u: s for u, s, _, _, _ in rows}
    family = {}
    for u, s, _, _, _ in rows:
        family.setdefault(s, []).append(u)
    cost = {s: sum(r[4] for r in rows if r[1] == s) for s in family}
    kind = {r[1]: r[3] for r in rows}
    small = {s for s in family if kind[s] == "function" and cost[s] <= 256}
    callers = {}
    for a, b in calls:
        if a in root and b in root and root[a] != root[b]:
            callers.setdefault(root[b], set()).add(root[a])
    out = {}
    for u, s in root.items():
        if s not in small:
            out[u] = [u]
            continue
        held, frontier = [s], [s]
        for _ in range(2):
            new = []
            for x in frontier:
                near = callers.get(x, set())
                if len(near) <= 4:
                    for c in sorted(near & small, key=lambda c: min(family[c])):
                        if c not in held and sum(cost[h] for h in held) + cost[c] <= 768:
                            held.append(c)
                            new.append(c)
            frontier = new
        out[u] = sorted(v for h in held for v in family[h])
    return out


def test_bundles_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, f"f{k // 2}", None, "module" if k // 2 % 9 == 0 else "function", rng.choice([20, 60, 110, 200])) for k in range(120)]
    calls = [(rng.randrange(120), rng.randrange(120) if rng.random() < 0.9 else 7) for _ in range(150)]
    got = graph.bundles(spark.createDataFrame(rows, "uid long, symbol string, owner string, kind string, cost long"), spark.createDataFrame(calls, "src long, dst long"))
    want = brute_bundles(rows, calls)
    assert {r.uid: r.bundle for r in got.collect()} == want
    assert max(map(len, want.values())) > 4


def test_index_is_built_once_checked_and_searched(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    rows = [(k, f"src/f{k}.py", f"f{k}", "python", "function", 1, f"def f{k}(): return parse_{k % 5} tokens here") for k in range(30)]
    made = spark.createDataFrame(rows, "uid long, path string, symbol string, language string, kind string, start int, text string")
    assert index.status(spark, root) == {"phase": "empty"}
    first = index.build(made, root)
    assert not first.cache_hit and index.build(made.orderBy(F.rand()), root).cache_hit
    assert index.status(spark, root)["units"] == 30
    queries = spark.createDataFrame([(1, "where is parse_3 defined"), (2, "f7")], "qid long, query string")
    whole = index.search(index.open_index(spark, root), queries, 300).collect()
    assert {r.qid for r in whole} == {1, 2} and all(r.spent <= 300 for r in whole)
    changed = made.withColumn("text", F.when(F.col("uid") == 4, "something else").otherwise(F.col("text")))
    again = index.build(changed, f"{root}-2", previous=first)
    plain = index.build(changed, f"{root}-3")
    key = lambda i: sorted(map(tuple, i.postings.collect()))
    assert key(again) == key(plain) != key(first)
    with pytest.raises(index.BadIndex):
        index.open_index(spark, root, "another")
    with pytest.raises(ValueError):
        index.search(first, queries, 100)
    with pytest.raises(Exception, match="too long"):
        index.search(first, spark.createDataFrame([(1, "x" * 9000)], "qid long, query string")).collect()
    first.postings.limit(1).write.mode("append").parquet(f"{root}/{first.info['version']}/postings")
    with pytest.raises(index.BadIndex):
        index.open_index(spark, root)


def test_stores_on_a_uri(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "key string, x int")
    assert store.put_missing(root, rows) == 2 and store.put_missing(root, rows) == 0
    assert spark.read.parquet(root).count() == 2
    versions = [store.publish(f"{root}-v", {"t": rows}, {"n": k}) for k in range(3)]
    info, tables = store.current(spark, f"{root}-v")
    assert info["n"] == 2 and tables["t"].count() == 3
    assert set(store.drop_versions(spark, f"{root}-v", 1)) == set(versions[:2])
    assert store.current(spark, f"{root}-v")[1]["t"].count() == 3
    with pytest.raises(ValueError):
        store.write_snapshot(rows, f"{root}/inner/x", root)
    listing = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "path string, length long, modified long")
    known, read = store.rehash(listing, listing.where("path = 'a'").withColumn("sha256", F.lit("h")))
    assert [r.path for r in known.collect()] == ["a"] and [r.path for r in read.collect()] == ["b"]


def test_manifests_are_checked(spark):
    digest = "0" * 64
    good = spark.createDataFrame([("a/b", digest)], "path string, sha256 string")
    assert store.admitted_paths(good, ".").count() == 1
    for bad in ([("a", digest), ("a", digest)], [("../a", digest)], [("/a", digest)], [("a", "x")]):
        with pytest.raises(Exception, match="manifest"):
            store.admitted_paths(spark.createDataFrame(bad, "path string, sha256 string"), ".").collect()
    files = spark.createDataFrame([("a", "text")], "path string, text string")
    frozen = spark.createDataFrame([("a", digest), ("b", digest)], "path string, sha256 string")
    assert sorted((r.path, r.fault) for r in store.frozen_faults(frozen, files).collect()) == [("a", "changed"), ("b", "missing")]


def test_json_fixtures(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"cases": [\n {"id": "a", "n": 1},\n {"id": "b", "n": 2}]}')
    assert [tuple(r) for r in store.fixtures(spark, str(tmp_path / "q.json"), "cases", "id:string,n:int").collect()] == [("a", 1), ("b", 2)]


def test_embedder_orders_checks_and_repeats():
    calls = []

    def post(url, body, key, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        return {"data": [{"index": k, "embedding": [float(k), 1.0]} for k in reversed(range(len(body["input"])))]}

    backends.PAUSE = 0
    one = backends.HttpEmbedder("http://x/", "m", post=post)
    assert one(["a", "b"]).tolist() == [[0.0, 1.0], [1.0, 1.0]] and calls == ["http://x/embeddings"] * 3
    for reply in ({"data": [{"index": 1, "embedding": [1.0]}]}, {"data": [{"index": 0, "embedding": [float("nan")]}]}):
        with pytest.raises(ValueError):
            backends.matrix_of(reply, 1, None)
    with pytest.raises(urllib.error.HTTPError):
        backends.with_retries(lambda: (_ for _ in ()).throw(urllib.error.HTTPError("u", 400, "no", {}, None)), pause=0)


def test_scorer_dialects():
    rows = {"results": [{"index": 1, "relevance_score": 0.2}, {"index": 0, "relevance_score": 0.9}]}
    assert backends.HttpScorer("u", "m", post=lambda *a: rows)("q", ["a", "b"]) == [0.9, 0.2]
    seen = []
    nested = backends.HttpScorer("u", "m", dialect="nested", post=lambda u, body, k, t: seen.append(body) or {"output": rows})
    assert nested("q", ["a", "b"]) == [0.9, 0.2] and seen[0]["input"]["documents"] == ["a", "b"]
    for bad in ([], [{"index": 0, "relevance_score": 2.0}], [{"index": 5, "relevance_score": 0.1}]):
        with pytest.raises(ValueError):
            backends.scores_of({"results": bad}, 1)
    row = {"index": 0, "query_index": 1, "document_index": 3, "relevance_score": 0.5}
    assert backends.batch_scores({"results": [row]}, [(1, 3)]) == [0.5]
    with pytest.raises(ValueError):
        backends.batch_scores({"results": [row]}, [(1, 2)])


def test_vectors_go_on_after_a_failure(spark, tmp_path):
    root = f"file://{tmp_path}/vectors"
    rows = spark.createDataFrame([(f"k{k}", f"t{k}") for k in range(40)], "key string, text string")

    def broken(texts):
        if "t7" in texts:
            raise RuntimeError("no reply")
        return np.ones((len(texts), 2))

    with pytest.raises(Exception, match="no reply"):
        backends.embed_missing(root, rows, broken, batch=3)
    done = spark.read.parquet(root).count() if store.Files(spark, root).names() else 0
    assert backends.embed_missing(root, rows, lambda texts: np.ones((len(texts), 2)), batch=3) == 40 - done
    assert spark.read.parquet(root).select("key").distinct().count() == 40
    blobs = spark.createDataFrame([("a", np.array([1.5, 2.0], dtype="<f4").tobytes()), ("b", None)], "key string, blob binary")
    assert {r.key: r.vec for r in backends.vectors_of(blobs).collect()} == {"a": [1.5, 2.0], "b": None}


def test_responses_must_map_to_their_documents(spark):
    requests = scoring.chunked(spark.createDataFrame([(1, k) for k in (5, 3, 5, 9)], "qid long, uid long"), 2)
    assert sorted((r.request, r.uids) for r in requests.collect()) == [(0, [3, 5]), (1, [9])]
    kind = "qid long, request long, results array<struct<index:int,relevance_score:double>>"
    good = spark.createDataFrame([(1, 0, [(1, 0.2), (0, 0.9)]), (1, 1, [(0, 0.5)])], kind)
    assert sorted(map(tuple, scoring.mapped(requests, good).collect())) == [(1, 3, 0.9), (1, 5, 0.2), (1, 9, 0.5)]
    for bad in ([(1, 0, [(0, 0.9), (0, 0.1)]), (1, 1, [(0, 0.5)])], [(1, 0, [(1, 0.2), (0, 1.9)]), (1, 1, [(0, 0.5)])], [(1, 0, [(1, 0.2), (0, 0.9)])]):
        with pytest.raises(Exception, match="does not map"):
            scoring.mapped(requests, spark.createDataFrame(bad, kind)).collect()


def test_listing_cursor_is_bound(spark):
    rows = spark.createDataFrame([(f"a/{k:02}", "indexed", None) for k in range(7)] + [("b", "excluded", "x")], "path string, status string, reason string")
    first, cursor = coverage.page(rows, "g", "a", 5)
    second, end = coverage.page(rows, "g", "a", 5, cursor)
    assert [r.path for r in first.collect()] + [r.path for r in second.collect()] == [f"a/{k:02}" for k in range(7)] and end is None
    for identity, path, c in (("h", "a", cursor), ("g", "b", cursor), ("g", "a", "rubbish")):
        with pytest.raises(ValueError):
            coverage.page(rows, identity, path, 5, c)
    with pytest.raises(ValueError):
        coverage.page(rows, "g", "a", 201)


def test_nothing_is_published_of_a_changed_source(spark, tmp_path):
    root = f"file://{tmp_path}/live"
    one, two = (spark.createDataFrame([("a", x)], "path string, sha256 string") for x in "xy")
    live.publish_unchanged(root, lambda: {"t": one}, lambda: one)
    assert live.await_identity(spark, root, live.manifest_identity(one), 1)["identity"] == live.manifest_identity(one)
    turns = iter([one, two])
    with pytest.raises(live.SourceChanged):
        live.publish_unchanged(root, lambda: {"t": two}, lambda: next(turns))
    assert store.current(spark, root)[0]["identity"] == live.manifest_identity(one)
    with pytest.raises(TimeoutError):
        live.await_identity(spark, root, live.manifest_identity(two), 0.3, 0.1)
    turns = iter([one, two])
    assert live.verified_read(lambda: 5, lambda: next(turns)) == (5, False)


def test_backoff_idle_and_deadline(spark):
    b = live.Backoff(poll=1)
    assert [b.failed("a") for _ in range(7)] == [2, 4, 8, 16, 32, 60, 60] and b.failed("b") == 2
    b.succeeded()
    assert b.failed("b") == 2
    i = live.Idle(last=0.0)
    assert [i.phase(t) for t in (10, 60, 119, 120)] == ["active", "paused", "paused", "unloaded"]
    assert live.run_with_deadline(spark, lambda: spark.range(5).count(), 60) == 5


def test_states_are_published_once_for_each_batch(spark, tmp_path):
    root = f"file://{tmp_path}/states"
    publish = live.publish_states(root)
    rows = lambda *x: spark.createDataFrame(list(x), "path string, state string, ts int")
    publish(rows(("a", "add", 1), ("b", "add", 1)), 0)
    publish(rows(("a", "delete", 2)), 1)
    publish(rows(("b", "lost", 9)), 1)
    assert sorted(map(tuple, store.current(spark, root)[1]["states"].collect())) == [("a", "delete", 2), ("b", "add", 1)]


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("p", 1, "old", 1), ("p", 1, "new", 2), ("p", 2, "x", 1)], "path string, line int, text string, at int")
    assert sorted(map(tuple, evaluate.last_written(rows).collect())) == [("p", 1, "new"), ("p", 2, "x")]
