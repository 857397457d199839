import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import queries

DATA = "/root/testdata/sf0.001"
CHECKED = ["tokenize_sanitize", "index_postings", "search_ranked", "search_fallback", "score_signals", "extract_fields", "html_title", "page_ids", "frontier_bfs"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(rows):
    def one(x):
        if isinstance(x, float):
            return round(x, 5)
        return tuple(map(one, x)) if isinstance(x, (list, tuple)) else x

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_queries_agree_with_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    expected = duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert canonical(tuple(r) for r in got.select(*cols).collect()) == canonical(expected)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
