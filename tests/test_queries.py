"""Queries of the table-backed corpus against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(Q.ORACLES[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == columns
    rows = lambda found, names: sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found)
    assert rows((tuple(r) for r in got.collect()), got.columns) == rows(want.fetchall(), order)


def test_no_cartesian_plans(spark):
    for name in ("mapping_suffix_ladder", "innermost_owner", "next_statement", "unmapped_sections"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(Q.QUERIES) >= 40
