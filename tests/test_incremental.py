"""The sales store after new files equals one built from all of them, and reads no line twice."""

import time

import pytest
from pyspark.sql import functions as F

from bizmetrics.functions.measures import read_sales_rollups, rollup, sales_rollups
from bizmetrics.operators import profitability, sales
from bizmetrics.plans.incremental import SalesStore
from bizmetrics.plans.report import build_report
from bizmetrics.sources import star


@pytest.fixture(scope="module")
def lines(spark, small):
    from bizmetrics.functions.lineage import cut_lineage

    return cut_lineage(star.sales(spark, small))


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def doubles(df):
    """Sums as doubles: their decimal types grow with the number of times they were added up."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def test_one_pass_rollups_equal_separate_ones(spark, lines, tmp_path):
    some = lines.withColumn("customer_name", F.when(F.col("customer_id") % 5 > 0, F.col("customer_name")))
    some = some.withColumn("margin_pct", F.when(F.col("customer_id") % 7 > 0, F.col("margin_pct")))
    got = sales_rollups(some, str(tmp_path / "r"))
    assert same(doubles(got.products), doubles(rollup(some, "date", "product_id", "product_name", "region")))
    assert same(doubles(got.customers), doubles(rollup(some, "customer_id", "customer_name")))
    assert same(profitability.products_to_promote(got.promotable, 50), profitability.products_to_promote(some, 50))
    again = read_sales_rollups(spark, str(tmp_path / "r"))
    assert same(again.promotable, got.promotable)
    empty = sales_rollups(some.limit(0))
    assert empty.products.count() == empty.customers.count() == empty.promotable.count() == 0


def months(lines, first, last):
    return lines.where((F.col("date") >= first) & (F.col("date") < last))


def check(store, lines):
    got = store.rollups()
    assert same(sales.monthly_panel(got.products), sales.monthly_panel(lines))
    assert same(sales.revenue_by_date(got.products).withColumn("revenue", F.col("revenue").cast("double")), sales.revenue_by_date(lines).withColumn("revenue", F.col("revenue").cast("double")))
    assert same(profitability.customer_features(got.customers), profitability.customer_features(lines))
    assert same(profitability.top_products_by_margin(got.products), profitability.top_products_by_margin(lines))
    assert same(profitability.products_to_promote(got.promotable, 20), profitability.products_to_promote(lines, 20))
    assert same(store.features(), sales.panel_features(sales.monthly_panel(lines)))


def test_refreshes_read_new_lines_only(spark, lines, tmp_path):
    folder, store = str(tmp_path / "files"), SalesStore(spark, str(tmp_path / "store"), most_parts=3)
    read = lambda paths: spark.read.parquet(*paths)
    with pytest.raises(ValueError, match="empty"):
        store.rollups()
    bounds = ["1990-01-01", "2000-06-01", "2001-01-01", "2001-04-01", "2001-06-01", "2002-01-01"]
    for number, (first, last) in enumerate(zip(bounds, bounds[1:]), 1):
        part = months(lines, first, last)
        if number == 3:  # touches two series only
            part = part.where("product_id in ('Brand#11', 'Brand#12') and region = 'ASIA'")
        part.write.parquet(f"{folder}/part{number}")
        version = store.refresh(folder, read)
        assert version.notes["lines"] == part.count() and version.notes["rebuilt"] == (number == 1)
        assert len(version.notes["parts"]) == (number if number <= 3 else number - 3)
        if number == 3:
            touched = spark.read.parquet(f"{version.path}/series")
            assert 0 < touched.count() <= 2
            written = spark.read.parquet(f"{version.path}/features")
            assert written.select("product_id", "region").distinct().exceptAll(touched).isEmpty()
        check(store, read([folder + f"/part{i}" for i in range(1, number + 1)]))
    assert store.refresh(folder, read) == version  # nothing new


def test_a_changed_file_means_reading_all_again(spark, lines, tmp_path):
    folder, store = str(tmp_path / "files"), SalesStore(spark, str(tmp_path / "store"))
    read = lambda paths: spark.read.parquet(*paths)
    old, new = months(lines, "1990-01-01", "2001-01-01"), months(lines, "2001-01-01", "2002-01-01")
    old.write.parquet(f"{folder}/old")
    new.write.parquet(f"{folder}/new")
    store.refresh(folder, read)
    time.sleep(0.01)
    new.limit(100).write.mode("overwrite").parquet(f"{folder}/new")
    version = store.refresh(folder, read)
    now = read([f"{folder}/old", f"{folder}/new"])
    assert version.notes["rebuilt"] and version.notes["lines"] == now.count()
    check(store, now)
    with_bounds = SalesStore(spark, str(tmp_path / "store"), promote_above=15.0)
    with pytest.raises(ValueError, match="empty"):
        with_bounds.rollups()


def test_a_report_from_the_store_equals_one_from_the_lines(spark, small, lines, tmp_path):
    from dataclasses import replace

    from bizmetrics.plans.catalog import star_tables

    folder, store = str(tmp_path / "files"), SalesStore(spark, str(tmp_path / "store"))
    for first, last in (("1990-01-01", "2001-08-01"), ("2001-08-01", "2002-01-01")):
        months(lines, first, last).write.parquet(f"{folder}/{first}")
        store.refresh(folder, lambda paths: spark.read.parquet(*paths))
    tables = replace(star_tables(spark, small), sales=lines)
    options = {"forecaster": "growth", "models": False}
    assert build_report(tables, sales_part=store.rollups(), **options).first() == build_report(tables, **options).first()
