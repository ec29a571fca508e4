"""Every catalogue query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from cairn.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in catalogue.ORACLES:
        assert len(df.columns) and isinstance(got, list)
        return
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == rows(rel.columns, rel.fetchall())
