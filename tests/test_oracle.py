"""Every query that SQL can express, against DuckDB at the smallest scale."""

import collections

import duckdb
import pytest

from cloudloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in "lineitem events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(rows):
    text = lambda v: "null" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, float) else str(v)
    return collections.Counter(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    names = [d[0] for d in want.description]
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert canonical(tuple(r) for r in got.select(columns).collect()) == canonical(rows)


def test_every_query_without_sql_has_rows(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).count() > 0, name
