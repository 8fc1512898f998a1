import json

import pytest
from plans import scans

from bizmetrics.operators import cashflow, tax
from bizmetrics.plans import report as r
from bizmetrics.plans.catalog import star_tables
from bizmetrics.sources.snapshot import read_report, write_report, write_tables


@pytest.fixture(scope="module")
def tables(spark, small):
    return star_tables(spark, small)


@pytest.fixture(scope="module")
def full(tables):
    from bizmetrics.functions.lineage import cut_lineage

    return cut_lineage(r.build_report(tables, regressor={"trees": 3}, forest={"trees": 10}))


def test_report_sections(full, tables):
    row = full.first()
    assert full.columns == ["sales", "cashflow", "inventory", "gst", "profitability"]
    assert len(row.sales.historical_monthly_revenue) == 80
    assert [f.ds.isoformat() for f in row.sales.forecast_next_3_months] == ["2001-09-01", "2001-10-01", "2001-11-01"]
    assert row.sales.anomaly_months == ["1996-07", "1998-05", "2001-07", "2001-08"]
    assert row.sales.winner_model in ("boosted_trees", "seasonal") and row.sales.trend in ("upward", "downward")
    revenue = [p.revenue for p in row.sales.top_5_products]
    assert len(revenue) == 5 and revenue == sorted(revenue, reverse=True)
    assert sum(row.cashflow.status_breakdown.values()) == tables.receivables.count()
    assert row.inventory.dead_stock_count == 28 and row.inventory.reorder_alerts == 6
    values = [c.value for c in row.inventory.dead_by_category]
    assert values == sorted(values, reverse=True)
    assert sum(c["count"] for c in row.inventory.dead_by_category) == 28
    assert row.gst.total_mismatches == 1001 == sum(row.gst.mismatch_type_breakdown.values())
    assert len(row.gst.monthly_mismatch_trend) == 6
    assert 0 < row.gst.isolation_forest_flags <= 720
    assert sum(row.profitability.customer_segments.values()) == 150
    assert len(row.profitability.products_to_promote) == len(row.profitability.products_to_discontinue) == 3


def test_a_saved_report_reads_back_as_it_was(spark, full, tmp_path):
    path = str(tmp_path / "report")
    assert read_report(spark, path) is None
    write_report(full, path)
    saved = read_report(spark, path)
    assert saved.schema == full.schema and saved.first() == full.first()


def test_each_table_is_read_once(spark, small):
    """Lines: the sales rollups, the stock items and the tax rollup, and the outlier forest's samples and scores."""
    with scans(spark) as seen:
        r.build_report(star_tables(spark, small), forecaster="growth", regressor={"trees": 1}, forest={"trees": 5})
    assert 3 <= seen("/lineitem.parquet") <= 5
    assert seen("/orders.parquet") == 2 and seen("/part.parquet") == 2


def test_rollups_of_invoices_and_tax_lines_give_what_the_lines_give(spark, tables):
    lines = tables.receivables
    assert cashflow.slow_payers(lines, 9).collect() == cashflow.slow_payers(cashflow.invoice_rollup(lines), 9).collect()
    for result in (cashflow.aging_counts, cashflow.overdue_by_region, cashflow.cashflow_totals):
        assert sorted(map(tuple, result(lines).collect())) == sorted(map(tuple, result(cashflow.invoice_rollup(lines)).collect()))
    for result in (tax.mismatch_reasons, tax.supplier_risk, tax.mismatch_trend, tax.tax_totals):
        assert sorted(map(tuple, result(tables.gst).collect())) == sorted(map(tuple, result(tax.tax_rollup(tables.gst)).collect()))
    with pytest.raises(ValueError, match="bounds"):
        cashflow.cashflow_totals(cashflow.invoice_rollup(lines), bounds=(-999, 0, 9999))
    assert cashflow.cashflow_totals(cashflow.invoice_rollup(lines.limit(0))).first() == cashflow.cashflow_totals(lines.limit(0)).first()


def test_report_from_csv_files(spark, tables, full, tmp_path):
    """From four CSV files to a saved report: the SQL figures equal those of the typed tables."""
    paths = {}
    for name in ("sales", "receivables", "inventory", "gst"):
        df = getattr(tables, name)
        df.coalesce(1).write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
        paths[name] = str(tmp_path / f"{name}.csv")
    options = {"forecaster": "growth", "models": False}
    with pytest.raises(ValueError, match="gst.cgst_amount"):  # more decimals than money keeps
        r.load_report(spark, paths, str(tmp_path / "saved"), **options)
    got = r.load_report(spark, paths, str(tmp_path / "saved"), allow_rejects=True, **options).first().asDict(recursive=True)
    want = r.build_report(tables, **options).first().asDict(recursive=True)

    def compare(a, b, at):
        if isinstance(b, dict):
            assert set(a) == set(b), at
            for key in b:
                compare(a[key], b[key], f"{at}.{key}")
        elif isinstance(b, list):
            assert len(a) == len(b), at
            for i, (x, y) in enumerate(zip(a, b)):
                compare(x, y, f"{at}[{i}]")
        elif isinstance(b, float):
            assert a == pytest.approx(b, rel=1e-9), at
        else:
            assert a == b or str(a) == str(b), at

    # ids are text in CSV files, so rows tied on the measure may come in another order
    compare(got, want, "report")


def test_json_dates(full):
    sales = json.loads(r.section_json(full).first().sales)
    assert sales["forecast_next_3_months"][0]["ds"] == "2001-09-01"


def test_feeds(spark, full, tmp_path):
    feeds = r.dashboard_feeds(full)
    assert {n: df.count() for n, df in feeds.items()} == {
        "forecast": 3, "top_products": 5, "slow_payers": 5, "mismatch_types": 3, "dead_stock": 5, "customer_risk": 5,
    }
    assert [row.place for row in feeds["top_products"].orderBy("place").collect()] == [1, 2, 3, 4, 5]
    write_tables({"forecast": feeds["forecast"]}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "forecast")).count() == 3


def test_unknown_forecaster(spark, tables):
    with pytest.raises(ValueError, match="unknown forecaster"):
        r.make_forecast(tables.sales, "crystal ball")
