"""Every registered query against its SQL on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from lullspark.plans.oracle import ORACLE
from lullspark.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in row) for row in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in names) for row in df.collect()), key=repr)
    assert got == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_whole_inputs_keep_what_the_thin_queries_leave_out(spark):
    def run(name):
        return QUERIES[name](spark, SF_DIR).toPandas()

    matrix = run("event_feature_matrix_thresholds")
    assert set(matrix["threshold"]) == {0.3, 0.35, 0.4} and len(matrix) > len(run("event_feature_matrix"))
    assert run("union_feeds_rows").shape[0] == run("union_feeds")["n"].sum()
    thin, whole = run("upsert_sparse"), run("upsert_sparse_whole")
    assert whole["purchase"].count() > thin["purchase"].count() and whole["error"].count() > thin["error"].count()
    assert run("merge_series_whole")["power_consumption_total"].count() > run("merge_series")["power_consumption_total"].count()
