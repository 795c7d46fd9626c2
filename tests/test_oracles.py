"""Every query with SQL against DuckDB, on the smallest tables."""

import __spark_entry__ as entry
import duckdb
import numpy as np
import pytest

from tsbags import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    assert len(a) == len(b)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (a, b))
    for c in names:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1.1e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_equals_duckdb(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL and n not in ("r6_hybrid", "r6_stream", "r6_hybrid_default_grid")])
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
