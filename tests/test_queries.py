"""Every registered query against its oracle SQL, over the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import close, rows_of
from workload.bindings import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SF)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        return
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    assert sorted(columns) == sorted(frame.columns)
    assert len(got) == len(want)
    assert all(close(a, b) for g, w in zip(got, want) for a, b in zip(g, w))
    spark.catalog.clearCache()


def test_requests_without_terms_are_answered_without_scores(spark):
    from workload.registry import QUERIES

    plan = QUERIES["search_match_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "score_0" not in plan and "InMemoryRelation" not in plan
