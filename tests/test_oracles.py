"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from sheetloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    cursor = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted(repr(tuple(row[i] for i in order)) for row in cursor.fetchall())


def test_no_cartesian_product_in_joins(spark):
    for name in ("j11_lookup_chain", "j15_band_join", "j16_grid_join", "j17_token_join", "j18_top_like", "l5_bits"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_filters_reach_the_scan(spark):
    plan = catalogue.queries()["a10_job_detail"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_partkey), EqualTo(l_partkey,7)" in plan


@pytest.mark.parametrize("name", ["a2_by_operador", "a3_daily_trend", "a5_weekly_trend", "a7_workers", "a9_jobs", "a11_client_matrix", "a17_sector_overview"])
def test_indicators_read_the_facts_once(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Relation [l_orderkey") == 1 and "Expand" not in plan
