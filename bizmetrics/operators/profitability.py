"""Profitability: decisions by margin, product and customer margins, lists to act on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizmetrics.functions.distinct import distinct_counts, distinct_rollup
from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.functions.measures import DISCONTINUE_BELOW, PROMOTE_ABOVE, as_measures, decision_of
from bizmetrics.functions.numeric import keyed, ratio, round_np, sum0
from bizmetrics.functions.ordering import top_k


def with_decision(
    sales: DataFrame, promote_above: float = PROMOTE_ABOVE, discontinue_below: float = DISCONTINUE_BELOW
) -> DataFrame:
    return sales.withColumn("decision", decision_of("margin_pct", promote_above, discontinue_below))


def decision_bands(sales: DataFrame, *by: str, **bounds: float) -> DataFrame:
    """Lines and revenue per decision, optionally by more columns."""
    return (
        with_decision(sales, **bounds)
        .groupBy(*by, "decision")
        .agg(F.count(F.lit(1)).alias("lines"), sum0("revenue").cast("double").alias("revenue"))
    )


def product_decision_counts() -> list[Column]:
    """Aggregates: products with a line to promote, with a line to discontinue."""
    return [
        _distinct_with_missing("product_id", "promote").alias("promote_count"),
        _distinct_with_missing("product_id", "discontinue").alias("discontinue_count"),
    ]


def customer_decision_counts() -> list[Column]:
    """Aggregate: customers with a line to renegotiate."""
    return [_distinct_with_missing("customer_id", "renegotiate").alias("renegotiate_count")]


def decision_counts(sales: DataFrame, *by: str, **bounds: float) -> DataFrame:
    """All three counts; a missing id counts as one value.

    Lines are combined per product and per customer first, so no line is copied to count different ids.
    """
    measures = keyed(as_measures(sales, **bounds), *by) if by else as_measures(sales, **bounds)

    def counted(key: str, **flags: str) -> DataFrame:
        per_id = measures.groupBy(*by, key).agg(*[F.coalesce(F.max(f), F.lit(0)).alias(f) for f in flags.values()])
        totals = [F.coalesce(F.sum(f), F.lit(0)).cast("bigint").alias(name) for name, f in flags.items()]
        return per_id.groupBy(*by).agg(*totals)

    products = counted("product_id", promote_count="promote", discontinue_count="discontinue")
    customers = counted("customer_id", renegotiate_count="renegotiate")
    if not by:
        return products.select("*", customers.scalar().alias("renegotiate_count"))
    return products.join(customers, list(by))


def decision_id_rollups(sales: DataFrame, *keys: str, **bounds: float) -> tuple[DataFrame, DataFrame]:
    """What ``decision_counts_of`` counts: products and customers per key as bitmaps, written to the checkpoint folder."""
    measures = as_measures(sales, **bounds)
    products = {"promote_count": F.col("promote") == 1, "discontinue_count": F.col("discontinue") == 1}
    customers = {"renegotiate_count": F.col("renegotiate") == 1}
    return (
        cut_lineage(distinct_rollup(measures, list(keys), "product_id", products)),
        cut_lineage(distinct_rollup(measures, list(keys), "customer_id", customers)),
    )


def decision_counts_of(rollups: tuple[DataFrame, DataFrame], *by: str | Column) -> DataFrame:
    """The three counts of ``decision_counts`` at any grain of the rollups' keys, without the lines."""
    products, customers = rollups
    first = distinct_counts(products, ["promote_count", "discontinue_count"], *by)
    second = distinct_counts(customers, ["renegotiate_count"], *by)
    if not by:
        return first.select("*", second.scalar().alias("renegotiate_count"))
    labels = first.columns[: len(by)]
    renamed = second.withColumnsRenamed({c: f"_{c}" for c in labels})
    same = [first[c].eqNullSafe(renamed[f"_{c}"]) for c in labels]
    return first.join(renamed, same).drop(*[f"_{c}" for c in labels])


def _distinct_with_missing(key: str, flag: str) -> Column:
    flagged = F.col(flag) == 1
    missing = F.max(F.when(flagged & F.col(key).isNull(), F.lit(1)).otherwise(F.lit(0)))
    return F.countDistinct(F.when(flagged, F.col(key))) + F.coalesce(missing, F.lit(0))


def _margin_by(sales: DataFrame, *keys: str) -> DataFrame:
    return (
        keyed(as_measures(sales), *keys)
        .groupBy(*keys)
        .agg(
            ratio(F.sum("margin_sum"), F.sum("margin_n")).alias("avg_margin"),
            sum0("revenue").alias("total_revenue"),
        )
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"avg_margin": round_np("avg_margin", 2), "total_revenue": round_np("total_revenue", 2)}
    )


def top_products_by_margin(sales: DataFrame, k: int = 5) -> DataFrame:
    products = _margin_by(sales, "product_id", "product_name")
    order = (F.desc_nulls_last("avg_margin"), F.asc("product_id"), F.asc("product_name"))
    return _rounded(top_k(products, k, *order))


def low_margin_customers(sales: DataFrame, k: int = 5) -> DataFrame:
    customers = _margin_by(sales, "customer_id", "customer_name")
    order = (F.asc_nulls_last("avg_margin"), F.asc("customer_id"), F.asc("customer_name"))
    return _rounded(top_k(customers, k, *order))


def customer_features(sales: DataFrame) -> DataFrame:
    """Revenue, mean margin and mean discount per customer."""
    return (
        keyed(as_measures(sales), "customer_id")
        .groupBy("customer_id")
        .agg(
            sum0("revenue").cast("double").alias("revenue"),
            ratio(F.sum("margin_sum"), F.sum("margin_n")).alias("margin"),
            ratio(F.sum("discount_sum"), F.sum("discount_n")).alias("discount"),
        )
    )


def products_to_promote(sales: DataFrame, k: int = 3, **bounds: float) -> DataFrame:
    """First distinct (product, margin) pairs among lines to promote, by date, product and margin."""
    if "first_date" not in sales.columns:  # else it is the rollup of lines to promote
        lines = with_decision(sales, **bounds).where(F.col("decision") == "Promote")
        sales = lines.groupBy("product_name", "margin_pct").agg(F.min("date").alias("first_date"))
    pairs = sales.withColumnRenamed("margin_pct", "net_margin_pct")
    order = (
        F.asc_nulls_last("first_date"),
        F.asc_nulls_last("product_name"),
        F.asc("net_margin_pct"),
    )
    return top_k(pairs, k, *order).select("rank", "product_name", round_np("net_margin_pct", 2).alias("net_margin_pct"))


def products_to_discontinue(sales: DataFrame, k: int = 3) -> DataFrame:
    """Products with the lowest margin on any line; a product without a name is kept."""
    lowest = as_measures(sales).groupBy("product_name").agg(F.min("margin_min").alias("net_margin_pct"))
    order = (F.asc_nulls_last("net_margin_pct"), F.asc_nulls_last("product_name"))
    return top_k(lowest, k, *order).select(
        "rank", "product_name", round_np("net_margin_pct", 2).alias("net_margin_pct")
    )
