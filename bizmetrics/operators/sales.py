"""Sales: product-region panel and its features, revenue series, anomalies, top products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.functions.measures import as_measures
from bizmetrics.functions.numeric import keyed, ratio, round_np, sum0, whole
from bizmetrics.functions.ordering import top_k, with_position

PANEL_KEYS = ("date", "product_id", "product_name", "region")
PANEL_ORDER = ("product_id", "region", "date", "product_name")


def monthly_panel(sales: DataFrame) -> DataFrame:
    """One row per date, product and region."""
    return (
        keyed(as_measures(sales.withColumn("date", F.to_date("date"))), *PANEL_KEYS)
        .groupBy(*PANEL_KEYS)
        .agg(
            sum0("revenue").cast("double").alias("revenue"),
            sum0("quantity_sold").cast("double").alias("quantity"),
            ratio(F.sum("margin_sum"), F.sum("margin_n")).alias("avg_margin"),
            ratio(F.sum("discount_sum"), F.sum("discount_n")).alias("avg_discount"),
            sum0("returns_qty").cast("double").alias("returns"),
            F.max("is_festive").alias("is_festive"),
        )
    )


def panel_features(panel: DataFrame) -> DataFrame:
    """Lags, rolling mean and deviation over three rows, calendar parts; incomplete rows dropped.

    Lags count rows, not months: a gap in a series is not filled. The rolling values
    include the current row and need three rows, so they follow from two lags and share
    the one window (one sort per series, whatever the number of features).
    """
    series = Window.partitionBy("product_id", "region").orderBy("date", "product_name")
    back = {k: F.lag("revenue", k).over(series) for k in (1, 2, 3, 12)}
    lagged = panel.withColumns({f"lag_{k}": column for k, column in back.items()})
    window = [F.col("revenue"), F.col("lag_1"), F.col("lag_2")]
    with_mean = lagged.withColumn("rolling_3", (window[2] + window[1] + window[0]) / F.lit(3.0))
    return (
        with_mean.withColumn("rolling_std3", F.sqrt(_squares(window, F.col("rolling_3")) / F.lit(2.0)))
        .withColumns({"month": F.month("date"), "quarter": F.quarter("date"), "year": F.year("date")})
        .drop("lag_2")
        .na.drop()
    )


def _squares(values: list[Column], centre: Column) -> Column:
    oldest, middle, newest = [(v - centre) * (v - centre) for v in reversed(values)]
    return oldest + middle + newest


def product_codes(features: DataFrame) -> DataFrame:
    """0-based code per product in order of appearance, which is the order of the ids."""
    products = features.select("product_id").distinct()
    return with_position(products, "product_id").select(
        "product_id", (F.col("position") - 1).alias("product_enc")
    )


def region_codes(features: DataFrame) -> DataFrame:
    """0-based code per region in order of appearance: by the first product sold there, then by name."""
    regions = features.groupBy("region").agg(F.min("product_id").alias("first_product"))
    return with_position(regions, "first_product", "region").select(
        "region", (F.col("position") - 1).alias("region_enc")
    )


def panel_encodings(features: DataFrame) -> DataFrame:
    """Both codings as one table (kind, value, code)."""
    features = cut_lineage(features.select("product_id", "region").distinct())
    products = product_codes(features).select(
        F.lit("product").alias("kind"), F.col("product_id").alias("value"), F.col("product_enc").alias("code")
    )
    regions = region_codes(features).select(
        F.lit("region").alias("kind"), F.col("region").alias("value"), F.col("region_enc").alias("code")
    )
    return products.unionByName(regions)


def panel_split(features: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Add the row position and whether the row is in the training part.

    The first share of the rows in (product, region, date) order trains, so the test part
    is the last products and not the last months.
    """
    placed = with_position(features, *PANEL_ORDER)
    cut = placed.agg(F.floor(F.count(F.lit(1)) * F.lit(float(train_share)))).scalar()
    return placed.withColumn("is_train", F.col("position") <= cut)


def panel_split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("is_train").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("product_id").alias("first_product"),
        F.max("product_id").alias("last_product"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
    )


def revenue_by_date(sales: DataFrame) -> DataFrame:
    """Revenue series in the exact type of the input; everything below starts from it.

    Its size is bounded by the calendar, not by the sales: partial sums per task make the
    shuffle carry one row per date and task.
    """
    days = sales.withColumn("date", F.to_date("date"))  # a time of day would leave the calendar's bound
    return keyed(days, "date").groupBy("date").agg(sum0("revenue").alias("revenue"))


def monthly_revenue(series: DataFrame) -> DataFrame:
    """Revenue per calendar month (``yyyy-MM``), one row per month whatever the grain of the dates."""
    return (
        series.groupBy(F.date_format("date", "yyyy-MM").alias("month"))
        .agg(F.sum("revenue").cast("double").alias("revenue"))
    )


def revenue_anomalies(series: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Dates whose revenue is more than ``threshold`` population deviations from the mean.

    The unpartitioned window runs over the date series only. A constant series has none.
    """
    everything = Window.partitionBy()
    value = F.col("revenue").cast("double")
    scored = series.select(
        "date",
        value.alias("revenue"),
        F.try_divide(value - F.avg(value).over(everything), F.stddev_pop(value).over(everything)).alias("z"),
    )
    return scored.where(F.abs("z") > F.lit(float(threshold))).select(
        F.date_format("date", "yyyy-MM").alias("month"), "revenue"
    )


def last_dates(series: DataFrame, base_dates: int = 6) -> DataFrame:
    """One row: last date, its revenue, and the mean revenue of the last dates."""
    return (
        series.orderBy(F.desc("date"))
        .limit(base_dates)
        .agg(
            F.max("date").alias("last_date"),
            whole(F.max_by("revenue", "date")).alias("revenue_last_month"),
            ratio(F.sum("revenue"), F.count("revenue")).alias("recent_mean"),
        )
    )


def top_products_by_revenue(sales: DataFrame, k: int = 5) -> DataFrame:
    products = (
        keyed(sales, "product_id", "product_name")
        .groupBy("product_id", "product_name")
        .agg(sum0("revenue").alias("revenue"))
    )
    order = (F.desc("revenue"), F.asc("product_id"), F.asc("product_name"))
    return top_k(products, k, *order).withColumn("revenue", F.col("revenue").cast("double"))
