"""Every query with SQL gives the rows that DuckDB gives for it; every query has rows."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from pagelattice.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 9) + 0.0
    return str(v)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "all_passed" in df.columns


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got
    sql = entry.oracle_sql().get(name)
    if sql:
        assert sorted(duck.sql(sql).columns) == names
        want = Counter(tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
        assert got == want


def test_queries_and_sql_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
