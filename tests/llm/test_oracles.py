"""The queries with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from cairn.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    df = Q.queries()[name](spark, SF)
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = duck.sql(Q.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    names = sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(duck.sql(f"select {', '.join(names)} from rel").fetchall(), key=repr)
