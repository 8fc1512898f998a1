"""The consolidated report, the KPI row and the dashboard feeds.

Results meet as scalar subqueries of a one-row table, so nothing is joined. A list or map
holds the rows of a top-k table or one row per month, region, category or reason, never
rows of the input.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.functions.measures import SalesRollups, sales_rollups
from bizmetrics.operators import cashflow, forecast, inventory, isolation, profitability, regression, sales, tax
from bizmetrics.operators.segments import customer_segments
from bizmetrics.sources.files import csv_rejects, read_csv, read_parquet, stage_csv
from bizmetrics.sources.holidays import indian_holidays
from bizmetrics.sources.snapshot import fingerprint, load_or_build


@dataclass(frozen=True)
class Tables:
    """The four input tables."""

    sales: DataFrame
    receivables: DataFrame
    inventory: DataFrame
    gst: DataFrame


@dataclass(frozen=True)
class Rollups:
    """What the report is made of: one additive rollup per table, and one row per stock item."""

    sales: SalesRollups
    invoices: DataFrame
    stock: DataFrame
    tax: DataFrame


def roll_up(tables: Tables, sales_part: SalesRollups | None = None) -> Rollups:
    """One pass over each table, side by side; each rollup is written to the checkpoint folder.

    ``sales_part`` stands in for the sales lines where their rollups are kept already.
    """
    sales_part, invoices, stock, tax_part = _side_by_side(
        tables.sales.sparkSession,
        lambda: sales_part or sales_rollups(tables.sales),
        lambda: cut_lineage(cashflow.invoice_rollup(tables.receivables)),
        lambda: cut_lineage(tables.inventory),
        lambda: cut_lineage(tax.tax_rollup(tables.gst)),
    )
    return Rollups(sales_part, invoices, stock, tax_part)


def build_report(
    tables: Tables,
    forecaster: str = "seasonal",
    models: bool = True,
    regressor: dict | None = None,
    forest: dict | None = None,
    holidays: DataFrame | str | None = "india",
    sales_part: SalesRollups | None = None,
) -> DataFrame:
    """One row of five structs: sales, cashflow, inventory, gst, profitability.

    Each table is read once, whatever the number of results (see ``roll_up``); only the outlier forest, whose scores are per
    line, reads the tax lines again: it writes their features down, for its samples and its scores. Independent steps, the model fits among them, are
    submitted together and share the cluster. ``models=False`` leaves out the regressor, the outlier flags and the segments.
    """
    spark = tables.sales.sparkSession
    rollups = roll_up(tables, sales_part)
    sales_cells, gst_cells, profit_cells = _side_by_side(
        spark,
        lambda: _sales_section(rollups.sales.products, forecaster, models, regressor or {}, holidays),
        lambda: _gst_section(rollups.tax, tables.gst, models, forest or {}),
        lambda: _profitability_section(rollups.sales, models),
    )
    return _one_row(
        spark,
        sales=_struct(sales_cells),
        cashflow=_struct(_cashflow_section(rollups.invoices)),
        inventory=_struct(_inventory_section(rollups.stock)),
        gst=_struct(gst_cells),
        profitability=_struct(profit_cells),
    )


def make_forecast(series: DataFrame, forecaster: str = "seasonal", holidays: DataFrame | str | None = "india") -> DataFrame:
    """Forecast of the total series and the model that made it; a series beyond the seasonal model gets the projection.

    ``holidays`` is a table (ds, name) or ``"india"``: the holidays of that calendar over the years of the series and the next.
    They count on the dates that they fall on.
    """
    if forecaster == "growth":
        return forecast.growth_projection(series).withColumn("model", F.lit("growth"))
    if forecaster == "seasonal":
        if isinstance(holidays, str):
            holidays = _calendar(series, holidays)
        return forecast.seasonal_forecast(series, holidays=holidays)
    raise ValueError(f"unknown forecaster {forecaster!r}: use 'seasonal' or 'growth'")


def _calendar(series: DataFrame, name: str) -> DataFrame | None:
    if name != "india":
        raise ValueError(f"unknown calendar {name!r}: use 'india' or give a table (ds, name)")
    first, last = series.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    return None if first is None else indian_holidays(series.sparkSession, first, last + 1)


def kpi_summary(tables: Tables, forecaster: str = "seasonal") -> DataFrame:
    """One row with the nine headline figures.

    Four of them come from the revenue series, which is written down (one row per date) so
    that the sales lines are read once.
    """
    series = cut_lineage(sales.revenue_by_date(tables.sales))
    ahead = make_forecast(series, forecaster)
    return _one_row(
        tables.sales.sparkSession,
        next_month_forecast=ahead.agg(F.min_by("yhat", "ds").cast("bigint")),
        last_month_actual=sales.last_dates(series).select("revenue_last_month"),
        trend=forecast.trend(ahead).select(F.initcap("trend")),
        anomaly_months=sales.revenue_anomalies(series).agg(F.count(F.lit(1))),
        cash=_struct(cashflow.cashflow_totals(tables.receivables).select("total_overdue", "dso_days")),
        stock=_struct(inventory.inventory_totals(tables.inventory).select("dead_stock_count", "reorder_alerts")),
        tax_at_risk=tax.tax_totals(tables.gst).select("total_itc_at_risk"),
    ).select(
        "next_month_forecast",
        "last_month_actual",
        "trend",
        "anomaly_months",
        F.col("cash.total_overdue").alias("overdue"),
        F.col("cash.dso_days").alias("dso_days"),
        F.col("stock.dead_stock_count").alias("dead_stock"),
        F.col("stock.reorder_alerts").alias("reorder_alerts"),
        "tax_at_risk",
    )


def kpi_of_report(report: DataFrame) -> DataFrame:
    """The same nine figures taken from a report."""
    return report.select(
        F.get("sales.forecast_next_3_months", F.lit(0))["yhat"].cast("bigint").alias("next_month_forecast"),
        F.col("sales.total_revenue_last_month").alias("last_month_actual"),
        F.initcap("sales.trend").alias("trend"),
        F.size("sales.anomaly_months").cast("bigint").alias("anomaly_months"),
        F.col("cashflow.total_overdue").alias("overdue"),
        F.col("cashflow.dso_days").alias("dso_days"),
        F.col("inventory.dead_stock_count").alias("dead_stock"),
        F.col("inventory.reorder_alerts").alias("reorder_alerts"),
        F.col("gst.total_itc_at_risk").alias("tax_at_risk"),
    )


def dashboard_feeds(report: DataFrame) -> dict[str, DataFrame]:
    """The six tables behind the dashboard charts, from a report."""
    lists = {
        "forecast": ("sales.forecast_next_3_months", "ds", "yhat"),
        "top_products": ("sales.top_5_products", "product_name", "revenue"),
        "slow_payers": ("cashflow.top_slow_payers", "customer_name", "total_overdue"),
        "dead_stock": ("inventory.top_dead_skus", "sku", "total_value_inr"),
        "customer_risk": ("profitability.low_margin_customers", "customer_name", "avg_margin"),
    }
    feeds = {
        name: report.select(F.posexplode(rows).alias("place", "row")).select(
            (F.col("place") + 1).alias("place"), *[F.col(f"row.{f}") for f in fields]
        )
        for name, (rows, *fields) in lists.items()
    }
    reasons = F.explode("gst.mismatch_type_breakdown").alias("mismatch_reason", "invoices")
    return feeds | {"mismatch_types": report.select(reasons)}


TABLE_NAMES = ("sales", "receivables", "inventory", "gst")


def load_tables(
    spark: SparkSession, paths: dict[str, str], date_format: str | None = None, multi_line: bool = False
) -> Tables:
    """The four tables from CSV files (``.csv``) or Parquet, by table name."""

    def read(name: str) -> DataFrame:
        if paths[name].endswith(".csv"):
            return read_csv(spark, paths[name], name, date_format, multi_line)
        return read_parquet(spark, paths[name], name)

    return Tables(**{name: read(name) for name in TABLE_NAMES})


def stage_tables(
    spark: SparkSession, paths: dict[str, str | list[str]], date_format: str | None = None, multi_line: bool = False, allow_rejects: bool = False
) -> dict[str, DataFrame]:
    """The named tables, CSV files read once and staged as Parquet.

    CSV fields that cannot be read, or only with rounding, are an error that names and counts them, unless
    ``allow_rejects`` takes them as they are then.
    """

    def stage(name: str) -> tuple[DataFrame, dict[str, int]]:
        files = paths[name]
        if (files if isinstance(files, str) else files[0]).endswith(".csv"):
            staged = stage_csv(spark, files, name, date_format, multi_line)
            return staged.rows, {f"{name}.{column}": n for column, n in staged.counts.items()}
        return read_parquet(spark, files, name), {}

    found = dict(zip(paths, _side_by_side(spark, *[partial(stage, name) for name in paths])))
    rejects = {column: n for _, counts in found.values() for column, n in counts.items()}
    if rejects and not allow_rejects:
        raise ValueError(f"fields that could not be read: {rejects}")
    return {name: rows for name, (rows, _) in found.items()}


def rejected_fields(
    spark: SparkSession, paths: dict[str, str], date_format: str | None = None, multi_line: bool = False
) -> dict[str, int]:
    """Fields of the CSV files that do not hold what their column should, as ``table.column`` with their number.

    To see them with file and text, use ``sources.files.stage_csv``.
    """
    found = {}
    for name, path in paths.items():
        if path.endswith(".csv"):
            counts = csv_rejects(spark, path, name, date_format, multi_line).first().asDict()
            found |= {f"{name}.{column}": n for column, n in counts.items() if n}
    return found


def load_report(
    spark: SparkSession,
    paths: dict[str, str],
    snapshot: str,
    refresh: bool = False,
    date_format: str | None = None,
    multi_line: bool = False,
    allow_rejects: bool = False,
    **options,
) -> DataFrame:
    """The report over the files at ``paths``, built once and then read from its snapshot.

    It is built again when an option or an input file has changed, and then saved next to the earlier ones.
    CSV fields that cannot be read, such as dates in another format, or only with rounding are an error that names and
    counts them, unless ``allow_rejects`` takes them as missing, or rounded.
    """

    def build() -> DataFrame:
        wanted = {name: path for name, path in paths.items() if name in TABLE_NAMES}
        return build_report(Tables(**stage_tables(spark, wanted, date_format, multi_line, allow_rejects)), **options)

    how = options | {"date_format": date_format, "multi_line": multi_line, "allow_rejects": allow_rejects}
    return load_or_build(spark, snapshot, build, refresh, fingerprint(spark, paths, how))


def section_json(report: DataFrame) -> DataFrame:
    """Each section of the report as JSON text, dates as ``yyyy-MM-dd``."""
    dates = {"dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd"}
    return report.select(*[F.to_json(c, dates).alias(c) for c in report.columns])


def _sales_section(
    products: DataFrame, forecaster: str, models: bool, regressor: dict, holidays: DataFrame | str | None
) -> DataFrame:
    spark = products.sparkSession
    series = cut_lineage(sales.revenue_by_date(products))
    ahead = cut_lineage(make_forecast(series, forecaster, holidays))
    cells = {
        "total_revenue_last_month": sales.last_dates(series).select("revenue_last_month"),
        "historical_monthly_revenue": _map(sales.monthly_revenue(series), "month", "revenue"),
        "forecast_next_3_months": _records(ahead.drop("model"), F.col("ds")),
        "forecast_model": ahead.agg(F.max("model")),
        "trend": forecast.trend(ahead),
        "anomaly_months": sales.revenue_anomalies(series).agg(F.sort_array(F.collect_list("month"))),
        "top_5_products": _records(sales.top_products_by_revenue(products)),
    }
    if models:
        table = regression.regression_table(sales.panel_features(sales.monthly_panel(products)))
        error = cut_lineage(regression.regressor_error(table, **regressor))
        seasonal = ahead.where("model = 'seasonal'").limit(1).count() > 0
        named = regression.winner("regressor_mape", seasonal)
        cells = {
            "winner_model": error.select(named),
            "regressor_mape": error.select("regressor_mape"),
        } | cells
    return _one_row(spark, **cells)


def _cashflow_section(receivables: DataFrame) -> DataFrame:
    return _extend(
        cashflow.cashflow_totals(receivables),
        top_slow_payers=_records(cashflow.slow_payers(receivables)),
        status_breakdown=_map(cashflow.aging_counts(receivables), "aging_bucket", "invoices"),
        region_overdue=_map(cashflow.overdue_by_region(receivables), "region", "overdue"),
    )


def _inventory_section(stock: DataFrame) -> DataFrame:
    return _extend(
        inventory.inventory_totals(stock),
        dead_by_category=_records(inventory.dead_by_category(stock), -F.col("value"), F.col("category")),
        top_dead_skus=_records(inventory.top_dead_skus(stock)),
        critical_reorders=_records(inventory.critical_reorders(stock)),
    )


def _gst_section(rollup: DataFrame, lines: DataFrame, models: bool, forest: dict) -> DataFrame:
    cells = {
        "mismatch_type_breakdown": _map(tax.mismatch_reasons(rollup), "mismatch_reason", "invoices"),
        "top_supplier_risks": _records(tax.supplier_risk(rollup)),
        "monthly_mismatch_trend": _map(tax.mismatch_trend(rollup), "return_period", "mismatches"),
    }
    if models:
        scored = lines.select(*isolation.KEYS, *isolation.FEATURES)
        known = {"rows": rollup.agg(F.coalesce(F.sum("complete"), F.lit(0))).first()[0], "partitions": isolation.tasks_for(scored)}
        flags = isolation.isolation_flags(scored, **known | forest)
        cells["isolation_forest_flags"] = isolation.isolation_flag_count(flags).select("flagged")
    return _extend(tax.tax_totals(rollup), **cells)


def _profitability_section(rollups: SalesRollups, models: bool) -> DataFrame:
    products, customers = rollups.products, rollups.customers
    cells = {
        "renegotiate_count": customers.agg(*profitability.customer_decision_counts()),
        "top_5_products": _records(profitability.top_products_by_margin(products)),
        "low_margin_customers": _records(profitability.low_margin_customers(customers)),
        "products_to_promote": _records(profitability.products_to_promote(rollups.promotable)),
        "products_to_discontinue": _records(profitability.products_to_discontinue(products)),
    }
    if models:
        segments = customer_segments(profitability.customer_features(customers))
        sizes = segments.groupBy(F.coalesce("segment_label", F.lit("Unplaced")).alias("segment_label")).agg(F.count(F.lit(1)).alias("customers"))
        cells["customer_segments"] = _map(sizes, "segment_label", "customers")
    return _extend(products.agg(*profitability.product_decision_counts()), **cells)


def _side_by_side(spark: SparkSession, *steps: Callable[[], DataFrame]) -> list[DataFrame]:
    """Run steps that submit jobs at the same time; results in the order given.

    Each step is wrapped on its own: threads with one wrapper would share one set of job properties.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        return [step.result() for step in running]


def _one_row(spark: SparkSession, **cells: DataFrame) -> DataFrame:
    """One row whose columns are the given one-row, one-column results."""
    return spark.range(1).select(*[cell.scalar().alias(name) for name, cell in cells.items()])


def _extend(row: DataFrame, **cells: DataFrame) -> DataFrame:
    return row.select("*", *[cell.scalar().alias(name) for name, cell in cells.items()])


def _struct(row: DataFrame) -> DataFrame:
    return row.select(F.struct("*"))


def _records(df: DataFrame, *order: Column) -> DataFrame:
    """All rows as one ordered list of structs; ordered by ``rank``, which is then left out."""
    order = order or (F.col("rank"),)
    fields = [c for c in df.columns if c != "rank"]
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("r"))))
    return df.agg(F.transform(rows, lambda row: row["r"]))


def _map(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))))
