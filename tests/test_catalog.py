"""Every registered query against its SQL twin at the smallest scale."""

import os

import pytest

import __spark_entry__
from gneiss.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLES:
        rel = duck.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == rows_of(list(rel.columns), rel.fetchall())
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["chunk_id", "rank_vec", "rank_kw", "rrf_score"]
    assert set(catalog.ORACLES) <= set(__spark_entry__.queries())
