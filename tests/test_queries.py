"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from readloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()) == got


def test_entry_point():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streamed_pairs(spark, tmp_path):
    from readloom.plans.config import Config
    from readloom.streaming import stream_counts

    lib = registry.lib(spark, DATA)
    one = lib.where("NOT is_rev").orderBy("ref_idx").first()["sequence"]
    spark.createDataFrame([(1, one[:80], None), (2, one[20:120], None)], "pair_id long, r1 string, r2 string").write.parquet(str(tmp_path / "in"))
    out = []
    source = spark.readStream.schema("pair_id long, r1 string, r2 string").parquet(str(tmp_path / "in"))
    q = stream_counts(source, lib, Config(), lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["score"] for r in out) == 2
