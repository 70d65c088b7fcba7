"""The registered queries with SQL give the same rows as another engine on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans import board_queries, label_queries, nested_queries, stream_queries

QUERIES, SQL = {}, {}
for m in (board_queries, label_queries, nested_queries, stream_queries):
    QUERIES |= m.QUERIES
    SQL |= m.ORACLE


def canon(rows):
    def c(v):
        return round(v, 6) if isinstance(v, float) else tuple(map(c, v)) if isinstance(v, list) else v

    return sorted((tuple(map(c, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def test_registry():
    q = entry.queries()
    assert set(QUERIES) <= set(q) and set(entry.oracle_sql()) <= set(q)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    r = con.execute(SQL[name])
    have = [d[0] for d in r.description]
    assert sorted(have) == cols
    assert canon(rows) == canon([[x[have.index(c)] for c in cols] for x in r.fetchall()])
