"""The queries' SQL against the queries, on the smallest tables."""

import os

import duckdb
import pytest

from tunerline.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    cols = [c[0] for c in want.description]
    out = queries.QUERIES[name](spark, DATA)
    assert sorted(out.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r) for r in out.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))
