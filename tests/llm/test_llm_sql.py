"""The queries of this subpackage that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from mvtrack.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, want = Q.QUERIES[name](spark, SF), con.sql(Q.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in ours.select(want.columns).collect()) == sorted(want.fetchall())
