"""The plans Spark runs: no Python, no cross joins, pruned scans, no growing broadcast."""

import functools
import re

import pytest

import oracle
from bizmetrics.plans.catalog import catalog

QUERIES = catalog()
# These write tables first, so the frame they return shows the last step only.
WRITING = ("answers", "report_", "snapshot_", "incremental_", "csv_", "late_customers_", "decision_counts_by_")
SQL_ONLY = sorted(n for n in oracle.oracle_sql() if not n.startswith(WRITING) and not n.endswith("_checks"))


def physical(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def plan_of(spark, small):
    return functools.cache(lambda name: physical(QUERIES[name](spark, small)))


@pytest.mark.parametrize("name", SQL_ONLY)
def test_sql_queries_stay_in_the_jvm_without_cross_joins(plan_of, name):
    plan = plan_of(name)
    for operator in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan, (name, operator)


@pytest.mark.parametrize("name", SQL_ONLY)
def test_lines_are_never_broadcast(plan_of, name):
    """Line and order scans feed a sort-merge join or an aggregate, not a broadcast."""
    plan = plan_of(name)
    tree = plan.split("\n\n\n")[0]
    if "SortMergeJoin" in tree and "lineitem.parquet" in plan:
        scan = next(b for b in plan.split("\n\n") if "lineitem.parquet" in b)
        number = re.search(r"\((\d+)\) Scan", scan).group(1)
        line = next(i for i, row in enumerate(tree.splitlines()) if f"({number})" in row)
        parents = _ancestors(tree.splitlines(), line)
        aggregate = next((i for i, p in enumerate(parents) if "HashAggregate" in p), len(parents))
        parents = parents[:aggregate]
        assert not any("BroadcastExchange" in p for p in parents)


def _ancestors(rows, index):
    depth = lambda row: len(row) - len(row.lstrip(" :+-"))
    out, level = [], depth(rows[index])
    for row in reversed(rows[:index]):
        if depth(row) < level:
            level = depth(row)
            out.append(row)
    return out


@pytest.mark.parametrize(
    "name, columns",
    [
        ("monthly_revenue", {"l_orderkey", "l_extendedprice", "l_discount"}),
        ("mismatch_trend", {"l_linestatus", "l_returnflag", "l_shipdate"}),
        ("tax_totals", {"l_linestatus", "l_returnflag", "l_extendedprice", "l_discount", "l_tax"}),
        ("products_to_discontinue", {"l_partkey", "l_discount", "l_tax"}),
    ],
)
def test_scans_read_only_what_the_query_needs(plan_of, name, columns):
    plan = plan_of(name)
    scan = next(b for b in plan.split("\n\n") if "lineitem.parquet" in b)
    schema = re.search(r"ReadSchema: struct<(.*)>", scan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == columns


def test_bucketed_lines_join_their_orders_without_a_shuffle(spark, small, plan_of):
    tree = plan_of("bucketed_monthly_panel").split("\n\n\n")[0].splitlines()
    join = next(i for i, row in enumerate(tree) if "SortMergeJoin" in row)
    depth = lambda row: len(row) - len(row.lstrip(" :+-"))
    below = [row for row in tree[join + 1 :] if depth(row) > depth(tree[join])]
    shuffles = [row for row in below if "Exchange" in row and "BroadcastExchange" not in row]
    assert shuffles == [] and sum("Scan parquet" in row for row in below) >= 2
    plain = plan_of("monthly_panel").split("\n\n\n")[0]
    assert plain.count(" Exchange (") == plan_of("bucketed_monthly_panel").split("\n\n\n")[0].count(" Exchange (") + 2


def test_filters_reach_the_scan(spark, tmp_path):
    from bizmetrics.operators import cashflow, tax
    from bizmetrics.sources.files import read_parquet

    spark.createDataFrame([("a", "A", 1, 1.0)], "customer_id string, customer_name string, days_overdue int, invoice_amount double").selectExpr(
        "*", "'1' invoice_no"
    ).write.parquet(str(tmp_path / "r"))
    assert "GreaterThan(days_overdue,0)" in physical(cashflow.slow_payers(read_parquet(spark, str(tmp_path / "r"))))
    spark.createDataFrame([(1, "x")], "mismatch_flag int, mismatch_reason string").write.parquet(str(tmp_path / "g"))
    assert "EqualTo(mismatch_flag,1)" in physical(tax.mismatch_reasons(read_parquet(spark, str(tmp_path / "g"))))


def test_windows_without_partitions_only_see_aggregates(plan_of):
    """Below every such window there is a limit or an aggregate."""
    for name in SQL_ONLY:
        tree = plan_of(name).split("\n\n\n")[0]
        rows = tree.splitlines()
        for i, row in enumerate(rows):
            if "Window (" in row and "WindowGroupLimit" not in row:
                below = "\n".join(rows[i + 1 :])
                assert "TakeOrderedAndProject" in below or "HashAggregate" in below or "Scan ExistingRDD" in below or "Scan parquet" not in below, name
