"""Every library query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from backline.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(rows, order):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.5f}" if isinstance(v, (bool, int, float)) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DIR)
    found = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(columns)
    ours = plain(frame.collect(), [frame.columns.index(c) for c in sorted(columns)])
    assert ours == plain(found.fetchall(), [columns.index(c) for c in sorted(columns)])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
