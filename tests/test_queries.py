"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from fathomline.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if isinstance(x, list | tuple):
        return tuple(map(norm, x))
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if x != x else round(x + 0.0, 6)
    return x if isinstance(x, int) else str(x)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows == sorted((tuple(norm(r[k]) for k in place) for r in want.fetchall()), key=str)
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
