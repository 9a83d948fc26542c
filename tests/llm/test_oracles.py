"""The queries that SQL can express, on whole tables."""

import duckdb
import pytest

from alertweave.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert got == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
