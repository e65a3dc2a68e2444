"""The registered queries that SQL can express against DuckDB, on the smallest tables."""

import os

import pytest

from readloom.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    df = registry.queries()[name](spark, DATA)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.collect()) == want and want
