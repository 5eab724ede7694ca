"""Every registered query against its SQL counterpart on the smallest tables, and the shape of its plan."""

import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name in ORACLE:
        cursor = duck.execute(ORACLE[name])
        expected = cursor.fetchall()
        assert canonical(rows, df.columns) == canonical(expected, [c[0] for c in cursor.description])
    else:
        assert rows


def test_matrix_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["cluster_sizes"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "c_mktsegment" not in plan
