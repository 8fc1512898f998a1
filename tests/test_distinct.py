"""Distinct counts by bitmaps: exact at every grain of one rollup, and when rollups are merged."""

import random

from pyspark.sql import functions as F

from bizmetrics.functions.distinct import distinct_counts, distinct_rollup, id_dictionary, merge_distinct
from bizmetrics.operators import cashflow, profitability
from bizmetrics.sources import star


def sample(spark, n=4_000, ids=900):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([None, 1, 2, 3]), rng.choice([None, *(f"id{i}" for i in range(ids))]), rng.random() < 0.3) for _ in range(n)]
    return spark.createDataFrame(rows, "k string, m int, id string, flag boolean")


def by_hand(df, *by):
    """Different ids and flagged ids; a missing id is one value."""
    mark = F.coalesce(F.col("id"), F.lit("missing"))
    found = df.groupBy(*by).agg(F.countDistinct(mark).alias("every"), F.countDistinct(F.when(F.col("flag"), mark)).alias("flagged"))
    return {tuple(r) for r in found.collect()}


NAMES = ["every", "flagged"]


def made(df, keys, *dictionary):
    return distinct_rollup(df, keys, "id", {"every": F.lit(True), "flagged": F.col("flag")}, *dictionary)


def test_counts_at_every_grain(spark):
    df = sample(spark)
    rollup = made(df, ["k", "m"])
    for by in (["k", "m"], ["k"], ["m"], []):
        assert {tuple(r) for r in distinct_counts(rollup, NAMES, *by).collect()} == by_hand(df, *by), by
    odd = (F.col("m") % 2).alias("odd")
    assert {tuple(r) for r in distinct_counts(rollup, NAMES, odd).collect()} == by_hand(df.withColumn("odd", F.col("m") % 2), "odd")
    nothing = made(df.limit(0), ["k"])
    assert distinct_counts(nothing, NAMES, "k").count() == 0
    assert tuple(distinct_counts(nothing, NAMES).first()) == (0, 0)


def test_ids_beyond_one_bitmap(spark):
    df = spark.range(100_000).select((F.col("id") % 2).alias("k"), F.col("id"), (F.col("id") % 3 == 0).alias("flag"))
    rollup = made(df, ["k"])
    assert rollup.select("bucket").distinct().count() == 4
    assert tuple(distinct_counts(rollup, NAMES).first()) == (100_000, 33_334)


def test_a_dictionary_grows_and_rollups_merge(spark):
    df = sample(spark)
    old, new = df.where("m = 1"), df.where("m is null or m > 1")
    first = id_dictionary(old, "id")
    grown = id_dictionary(new, "id", first)
    numbers = [r.number for r in grown.orderBy("number").collect()]
    assert numbers == list(range(1, len(numbers) + 1)) and first.exceptAll(grown).isEmpty()
    parts = [made(part, ["k", "m"], grown) for part in (old, new)]
    merged = merge_distinct(*parts, ["k", "m"])
    for by in (["k"], []):
        assert {tuple(r) for r in distinct_counts(merged, NAMES, *by).collect()} == by_hand(df, *by)


def test_decisions_and_late_customers_by_grain(spark, small):
    lines = star.sales(spark, small, "date", "region", "product_id", "customer_id", "margin_pct")
    rollups = profitability.decision_id_rollups(lines, "date", "region")
    for by in (("date", "region"), ("region",), ()):
        got = profitability.decision_counts_of(rollups, *by)
        want = profitability.decision_counts(lines, *by).select(got.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), by
    invoices = star.receivables(spark, small)
    late = cashflow.late_customers(cashflow.late_customer_rollup(invoices, "region"))
    assert late.first()[0] == cashflow.cashflow_totals(invoices).first().slow_payer_count
