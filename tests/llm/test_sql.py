"""Queries with SQL against DuckDB, on the smallest tables and on tables of odd rows."""

import duckdb
import pytest

from locusflow.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " \t\n", "one", "a b c d e f", "A B C D E F", "a b c d e f g", "x" * 5000, "w " * 3000, "é ü ñ 漢字   x y z q r s", "line one two three\n" * 5, "t0k #$% | <&> *** 1 2 3"] + ["same words in every copy of this text here"] * 4


def plain(x):
    if x is None or x != x:
        return ""
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def same(df, con, sql):
    columns = sorted(df.columns)
    expected = con.sql(sql)
    assert sorted(expected.columns) == columns
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [expected.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())


def views(con, where):
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet/*.parquet'" if where != DATA else f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, ties, repeats, and columns with clashing names."""
    where = tmp_path_factory.mktemp("odd")
    docs = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), i, "x", 1) for i, t in enumerate(ODD_TEXTS)]
    docs += [docs[4], docs[8], (None, "a b c d e f", "en", "s1", 11, 1, "x", 1), (None, None, None, None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, n int, words string, rank int").write.parquet(f"{where}/documents.parquet")
    pages = [(i, u, h, "x") for i, (u, h) in enumerate([(None, None), ("no scheme", ""), ("HTTP://A.Example.COM/en/?q", "<p>é</p>"), ("http://x.net/es/1", "<p>é</p>"), ("http://x.net/es/1", "<p>é</p>"), ("http://com", None), ("http://a\r\nb.org/x", "t\r\n\r\nWARC/1.0\r\n")])]
    pages += [pages[3], (None, "http://y.net/fr/", "<p>é</p>", "x"), (None, None, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string, payload string").write.parquet(f"{where}/pages.parquet")
    v = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 1), (10, [], 1), (11, [0.0, 1.0], 1), (9, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, None, None)]
    spark.createDataFrame([(*r, 3) for r in v], "vec_id long, embedding array<float>, label int, rep int").write.parquet(f"{where}/embeddings.parquet")
    return str(where)


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    where = tmp_path_factory.mktemp("empty")
    for t in ("documents", "pages", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{where}/{t}.parquet")
    return str(where)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    views(con, DATA)
    same(QUERIES[name](spark, DATA), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb_on_odd_rows(spark, odd, name):
    con = duckdb.connect()
    views(con, odd)
    same(QUERIES[name](spark, odd), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_odd_rows_are_all_there(spark, odd, name):
    key = "page_id" if name.startswith("op3") else "doc_id"
    rows = QUERIES[name](spark, odd).collect()
    assert {r[key] for r in rows} == {None, *range(7 if key == "page_id" else len(ODD_TEXTS))}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []
