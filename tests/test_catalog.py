"""Every catalogue query with SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from locusflow.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer orders part lineitem events embeddings".split()


def _plain(x):
    if x is None or x != x:
        return ""
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    rows = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    at = [expected.columns.index(c) for c in columns]
    assert rows == sorted(tuple(_plain(r[i]) for i in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert rows
    assert all(math.isfinite(v) for r in rows for v in r.asDict().values() if isinstance(v, float))
