"""Every query of the library against its SQL on the small tables."""

import os

import duckdb
import pytest

from tunerline.plans import extension_queries, table_queries, text_queries  # noqa: F401
from tunerline.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def _norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str([_norm(v) for v in r]) for r in df.select(*cols).collect())
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str([_norm(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want
