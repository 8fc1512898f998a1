"""Every query with a SQL twin gives exactly DuckDB's columns, types and rows."""

import pytest
from compare import duckdb_result, spark_result

import __spark_entry__ as driver
import oracle
from bizmetrics.plans.catalog import catalog

ORACLE = oracle.oracle_sql()
QUERIES = catalog()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, medium, name):
    assert spark_result(QUERIES[name](spark, medium)) == duckdb_result(medium, ORACLE[name])


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 1
    assert rows[0].dead_stock == 28 and rows[0].reorder_alerts == 6 and rows[0].anomaly_months == 4
