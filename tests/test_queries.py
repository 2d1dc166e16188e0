"""The registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from lorefield.plans import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if hasattr(value, "as_tuple"):  # decimals
        return float(f"{float(value):.9g}")
    return value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in order) for r in expected.fetchall()), key=str)
    assert [tuple(map(str, map(_num, x))) for x in a] == [tuple(map(str, map(_num, x))) for x in b]


def _num(x):
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
