"""Every corpus query with a SQL twin gives exactly DuckDB's columns, types and rows; native ones never leave the JVM."""

import pytest
from compare import duckdb_result, spark_result

from bizmetrics.llm import catalog

ORACLE = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, medium, name):
    assert spark_result(QUERIES[name](spark, medium)) == duckdb_result(medium, ORACLE[name])


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_quality_rules", "op5_line_dedup", "op9_source_mixing"])
def test_native_queries_stay_in_the_jvm_without_cross_joins(spark, small, name):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = QUERIES[name](spark, small)._jdf.queryExecution().explainString(mode)
    for operator in ("ArrowEvalPython", "BatchEvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan, (name, operator)
