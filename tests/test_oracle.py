"""Every core query that SQL can express, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from mvtrack.plans import chain, details, labels, rebuild, training  # noqa: F401  they register their queries
from mvtrack.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return "None" if isinstance(v, float) and math.isnan(v) else f"{float(v):.5f}"

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours = Q.QUERIES[name](spark, SF)
    want = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(want.columns)
    got, expected = norm(ours.collect(), ours.columns), norm(want.fetchall(), want.columns)
    assert got == expected


def test_joins_are_equi_joins(spark):
    for name in ("a1_pair_affinity", "j3_must_not_link", "j4_nearest_detection", "j13_camera_overlap", "f1_closest_approach"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
