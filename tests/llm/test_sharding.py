import zlib
from hashlib import md5

import duckdb
import pandas as pd

from fathomline.llm import ranking
from fathomline.llm.sharding import shard, sql


def jump(doc_id, n):
    key = int(md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


ROWS = [(i, f"text é {i % 7}" * (i % 5), "x", 1) for i in range(1500)] + [(7, "again", "y", 2), (7, "again", "y", 2), (None, None, None, None), (None, "n", None, 3), (9000, "x" * 100_000, "", 0)]
SCHEMA = "doc_id long, text string, _digest string, slot int"


def test_matches_the_algorithm(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 10)
    got = shard(spark.createDataFrame(ROWS, SCHEMA), 40).collect()
    assert len(got) == len(ROWS)
    assert {r.law for r in got} == {"key"}
    slots = {}
    for r in got:
        assert r.shard == jump(r.doc_id, 40) and r.grown_shard == jump(r.doc_id, 41) and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want


def test_equals_sql(spark):
    rows = [(i, t) for i, t, _, _ in ROWS[:1500]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 40)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(sql(40)).fetchall())


def test_growing_moves_the_necessary_fraction(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    got = shard(df, 9).collect()
    moved = sum(r.grown_shard != r.shard for r in got) / len(got)
    assert abs(moved - 1 / 10) < 0.01


def test_edges(spark):
    assert shard(spark.createDataFrame([], SCHEMA), 40).collect() == []
    assert {r.shard for r in shard(spark.createDataFrame(ROWS, SCHEMA), 1).collect()} == {0}
    assert max(r.shard for r in shard(spark.createDataFrame(ROWS, SCHEMA), 5000).collect()) < 5000
