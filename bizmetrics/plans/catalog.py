"""Every operator as a named query over the star-schema folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage, new_table
from bizmetrics.operators import (
    cashflow,
    forecast,
    inventory,
    isolation,
    profitability,
    questions,
    regression,
    sales,
    segments,
    tax,
)
from bizmetrics.plans import checks
from bizmetrics.plans.incremental import SalesStore
from bizmetrics.plans.report import Tables, build_report, dashboard_feeds, kpi_of_report, kpi_summary, section_json
from bizmetrics.sources import star
from bizmetrics.sources.files import stage_csv
from bizmetrics.sources.holidays import indian_holidays, to_month_starts
from bizmetrics.sources.snapshot import load_or_build

Query = Callable[[SparkSession, str], DataFrame]

# The test questions speak of the 1990s.
SECOND_REFRESH = "2001-01-01"
TEST_ROUTING = {"gate": "199", "years": ("1997", "1998", "1999")}


def star_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        sales=star.sales(spark, sf_dir),
        receivables=star.receivables(spark, sf_dir),
        inventory=star.inventory(spark, sf_dir),
        gst=star.gst(spark, sf_dir),
    )


def catalog() -> dict[str, Query]:
    return {
        "monthly_panel": lambda s, d: _panel(s, d),
        "bucketed_monthly_panel": _bucketed_monthly_panel,
        "panel_features": lambda s, d: _features(s, d),
        "panel_encodings": lambda s, d: sales.panel_encodings(_features(s, d)),
        "panel_split_counts": lambda s, d: sales.panel_split_counts(sales.panel_split(_features(s, d))),
        "monthly_revenue": lambda s, d: sales.monthly_revenue(_series(s, d)),
        "revenue_anomalies": lambda s, d: sales.revenue_anomalies(_series(s, d)),
        "last_month_revenue": lambda s, d: sales.last_dates(_series(s, d)),
        "top_products_by_revenue": lambda s, d: sales.top_products_by_revenue(
            star.sales(s, d, "product_id", "product_name", "revenue")
        ),
        "fallback_forecast": lambda s, d: forecast.growth_projection(_series(s, d)),
        "forecast_trend": lambda s, d: forecast.trend(forecast.growth_projection(_series(s, d))),
        "receivable_buckets": _receivable_buckets,
        "slow_payers": lambda s, d: cashflow.slow_payers(
            star.receivables(s, d, "customer_id", "customer_name", "invoice_no", "invoice_amount", "days_overdue")
        ),
        "aging_counts": lambda s, d: cashflow.aging_counts(star.receivables(s, d, "aging_bucket")),
        "overdue_by_region": lambda s, d: cashflow.overdue_by_region(
            star.receivables(s, d, "region", "invoice_amount", "days_overdue")
        ),
        "cashflow_totals": lambda s, d: cashflow.cashflow_totals(
            star.receivables(
                s, d, "customer_id", "invoice_amount", "invoice_date", "received_date", "days_overdue", "aging_bucket"
            )
        ),
        "dead_by_category": lambda s, d: inventory.dead_by_category(star.inventory(s, d)),
        "top_dead_skus": lambda s, d: inventory.top_dead_skus(star.inventory(s, d)),
        "critical_reorders": lambda s, d: inventory.critical_reorders(star.inventory(s, d)),
        "inventory_totals": lambda s, d: inventory.inventory_totals(star.inventory(s, d)),
        "mismatch_reasons": lambda s, d: tax.mismatch_reasons(star.gst(s, d, "mismatch_flag", "mismatch_reason")),
        "supplier_risk": lambda s, d: tax.supplier_risk(star.gst(s, d)),
        "mismatch_trend": lambda s, d: tax.mismatch_trend(star.gst(s, d, "return_period", "mismatch_flag")),
        "tax_totals": lambda s, d: tax.tax_totals(star.gst(s, d, "mismatch_flag", "total_tax_amount")),
        "decision_bands": lambda s, d: profitability.decision_bands(
            star.sales(s, d, "product_id", "margin_pct", "revenue"), "product_id"
        ),
        "decision_counts": lambda s, d: profitability.decision_counts(
            star.sales(s, d, "date", "region", "product_id", "customer_id", "margin_pct"), "date", "region"
        ),
        "top_products_by_margin": lambda s, d: profitability.top_products_by_margin(
            star.sales(s, d, "product_id", "product_name", "revenue", "margin_pct")
        ),
        "low_margin_customers": lambda s, d: profitability.low_margin_customers(
            star.sales(s, d, "customer_id", "customer_name", "revenue", "margin_pct")
        ),
        "customer_features": _customer_features,
        "products_to_promote": lambda s, d: profitability.products_to_promote(
            star.sales(s, d, "date", "product_name", "margin_pct")
        ),
        "products_to_discontinue": lambda s, d: profitability.products_to_discontinue(
            star.sales(s, d, "product_name", "margin_pct")
        ),
        "kpi_summary": kpi_query,
        "question_months": lambda s, d: questions.question_months(
            star.questions(s, d), sales.monthly_revenue(_series(s, d)), **TEST_ROUTING
        ),
        "question_intents": lambda s, d: questions.question_intents(star.questions(s, d)),
        "answers": _answers,
        "isolation_flags": _isolation_flags,
        "customer_segments": lambda s, d: segments.customer_segments(_customer_features(s, d)),
        "segment_margins": lambda s, d: segments.segment_margins(
            segments.customer_segments(_customer_features(s, d))
        ),
        "regressor_mape": lambda s, d: regression.regressor_error(regression.regression_table(_features(s, d))),
        "seasonal_forecast": lambda s, d: forecast.seasonal_forecast(_series(s, d)),
        "seasonal_forecast_by_panel": lambda s, d: forecast.seasonal_forecast(
            _panel(s, d), keys=("product_id", "region")
        ),
        "report_headlines": lambda s, d: kpi_of_report(_sql_report(s, d)),
        "report_lists": _report_lists,
        "full_report": lambda s, d: build_report(star_tables(s, d)),
        "snapshot_headlines": _snapshot_headlines,
        "report_json": _report_json,
        "incremental_panel_features": lambda s, d: _refreshed_store(s, d).features(),
        "incremental_customer_features": lambda s, d: profitability.customer_features(_refreshed_store(s, d).rollups().customers),
        "incremental_promotions": lambda s, d: profitability.products_to_promote(_refreshed_store(s, d).rollups().promotable),
        "decision_counts_by_grain": _decision_counts_by_grain,
        "late_customers_by_grain": _late_customers_by_grain,
        "csv_cashflow_totals": lambda s, d: cashflow.cashflow_totals(_staged_receivables(s, d)),
        "csv_rejects": _csv_rejects,
        "outlier_checks": lambda s, d: checks.outlier_checks(_isolation_flags(s, d), isolation.CONTAMINATION),
        "quantile_of_tax": lambda s, d: checks.quantiles(star.gst(s, d, "total_tax_amount"), "total_tax_amount", (0.0, 0.12, 0.5, 0.95, 1.0)),
        "scaled_customers": _scaled_customers,
        "segment_checks": lambda s, d: checks.segment_checks(segments.customer_segments(_customer_features(s, d))),
        "regressor_checks": lambda s, d: checks.regressor_checks(regression.regression_table(_features(s, d)), trees=30),
        "seasonal_forecast_holidays": _seasonal_forecast_holidays,
        "seasonal_checks": lambda s, d: checks.seasonal_checks(forecast.seasonal_forecast(_series(s, d))),
    }


def _bucketed_monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel from lines and orders that were stored bucketed by order."""
    buckets = max(8, spark.sparkContext.defaultParallelism)
    return _panel(spark, star.write_bucketed(spark, sf_dir, new_table(spark), buckets))


def _snapshot_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headlines of a report that was saved as a version and read back."""
    folder = new_table(spark)
    return kpi_of_report(load_or_build(spark, folder, lambda: _sql_report(spark, sf_dir), made_from=sf_dir))


def _report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast as it reads in the report's JSON: dates are ``yyyy-MM-dd`` text."""
    text = section_json(cut_lineage(_sql_report(spark, sf_dir)))
    months = F.from_json("sales", "forecast_next_3_months array<struct<ds:string,yhat:double>>")
    return text.select(F.inline(months["forecast_next_3_months"]))


def _refreshed_store(spark: SparkSession, sf_dir: str) -> SalesStore:
    """A store that took in the sales lines in two refreshes, the second with the later files only."""
    folder = new_table(spark)
    lines, files = star.sales(spark, sf_dir), f"{folder}/lines"
    store = SalesStore(spark, f"{folder}/store")
    for name, part in (("earlier", F.col("date") < SECOND_REFRESH), ("later", F.col("date") >= SECOND_REFRESH)):
        lines.where(part).write.parquet(f"{files}/{name}")
        store.refresh(files, lambda paths: spark.read.parquet(*paths))
    return store


def _decision_counts_by_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three grains from one rollup by month and region."""
    lines = star.sales(spark, sf_dir, "date", "region", "product_id", "customer_id", "margin_pct")
    rollups = profitability.decision_id_rollups(lines, "date", "region")
    counts = ["promote_count", "discontinue_count", "renegotiate_count"]
    grains = {
        "month and region": (F.date_format("date", "yyyy-MM").alias("period"), F.col("region")),
        "year": (F.date_format("date", "yyyy").alias("period"), F.lit("").alias("region")),
        "all": (F.lit("").alias("period"), F.lit("").alias("region")),
    }
    parts = [
        profitability.decision_counts_of(rollups, *by).select(F.lit(grain).alias("grain"), "period", "region", *counts)
        for grain, by in grains.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _late_customers_by_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = star.receivables(spark, sf_dir, "region", "aging_bucket", "customer_id", "days_overdue")
    rollup = cut_lineage(cashflow.late_customer_rollup(invoices, "region", "aging_bucket"))
    grains = [("region", "aging_bucket"), ("region",), ()]
    parts = [
        cashflow.late_customers(rollup, *by).select(
            *[F.col(c) if c in by else F.lit("").alias(c) for c in ("region", "aging_bucket")], "slow_payer_count"
        )
        for by in grains
    ]
    return reduce(DataFrame.unionByName, parts)


def _staged_receivables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices written as CSV files with columns in two orders, and read back by name."""
    invoices, folder = star.receivables(spark, sf_dir), new_table(spark)
    odd = F.col("invoice_no") % 2 == 1
    invoices.where(~odd).write.option("header", True).csv(f"{folder}/even")
    invoices.where(odd).select(*reversed(invoices.columns)).write.option("header", True).csv(f"{folder}/odd")
    return stage_csv(spark, f"{folder}/*", "receivables").rows


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the tax lines that lose something on the way through CSV files: more decimals than money has."""
    folder = new_table(spark)
    star.gst(spark, sf_dir).write.option("header", True).csv(folder)
    lost = stage_csv(spark, folder, "gst").rejects
    return lost.groupBy("column", "reason").agg(F.count(F.lit(1)).alias("fields"), F.count_distinct("text").alias("texts"))


def _seasonal_forecast_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast with every holiday counted in its month."""
    series = cut_lineage(_series(spark, sf_dir))
    first, last = series.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    days = to_month_starts(indian_holidays(spark, first, last + 1))
    return forecast.seasonal_forecast(series, holidays=days)


def _scaled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = segments.scaled_features(_customer_features(spark, sf_dir))
    return scaled.select("customer_id", *[F.round(c, 6).alias(c) for c in segments.FEATURES])


def kpi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline figures, each from the columns it needs."""
    return kpi_summary(
        Tables(
            sales=star.sales(spark, sf_dir, "date", "revenue"),
            receivables=star.receivables(
                spark, sf_dir, "customer_id", "invoice_amount", "invoice_date", "received_date", "days_overdue",
                "aging_bucket",
            ),
            inventory=star.inventory(spark, sf_dir),
            gst=star.gst(spark, sf_dir, "mismatch_flag", "total_tax_amount"),
        ),
        forecaster="growth",
    )


def _panel(spark: SparkSession, sf_dir: str | star.BucketedStar) -> DataFrame:
    return sales.monthly_panel(
        star.sales(
            spark, sf_dir, "date", "product_id", "product_name", "region", "revenue", "quantity_sold", "margin_pct",
            "discount_pct", "returns_qty", "is_festive",
        )
    )


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.panel_features(_panel(spark, sf_dir))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.revenue_by_date(star.sales(spark, sf_dir, "date", "revenue"))


def _customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profitability.customer_features(
        star.sales(spark, sf_dir, "customer_id", "revenue", "margin_pct", "discount_pct")
    )


def _isolation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star.gst(spark, sf_dir, *isolation.KEYS, *isolation.FEATURES)
    return isolation.isolation_flags(lines, partitions=isolation.tasks_for(lines))


def _receivable_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = star.receivables(spark, sf_dir, "invoice_no", "invoice_amount", "days_overdue")
    return cashflow.expected_inflow(invoices).select(
        "invoice_no",
        F.col("bucket").cast("bigint").alias("bucket"),
        F.col("cprob").cast("double").alias("cprob"),
        F.col("exp_inflow").cast("double").alias("exp_inflow"),
    )


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = cut_lineage(_sql_report(spark, sf_dir))
    monthly = report.select(F.explode("sales.historical_monthly_revenue").alias("month", "revenue"))
    return questions.answers(star.questions(spark, sf_dir), report, monthly, **TEST_ROUTING)


def _sql_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report without its model results, so that plain SQL can check it."""
    return build_report(star_tables(spark, sf_dir), forecaster="growth", models=False)


def _report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of the dashboard, read back from the report, as one table."""
    charts = [
        feed.select(
            F.lit(name).alias("chart"),
            F.col(feed.columns[-2]).cast("string").alias("label"),
            F.col(feed.columns[-1]).cast("double").alias("value"),
        )
        for name, feed in dashboard_feeds(cut_lineage(_sql_report(spark, sf_dir))).items()
    ]
    return reduce(DataFrame.unionByName, charts)
