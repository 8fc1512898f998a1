"""Stock: dead items, capital locked in them, reorder alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizmetrics.functions.numeric import count_where, keyed, percent, round_np, sum0, sum_where, whole
from bizmetrics.functions.ordering import top_k


def _dead() -> Column:
    return F.col("is_dead_stock") == 1


def _reorder() -> Column:
    return F.col("needs_reorder") == 1


def dead_by_category(inventory: DataFrame) -> DataFrame:
    """Dead items and their value per category, highest value first."""
    return (
        keyed(inventory.where(_dead()), "category")
        .groupBy("category")
        .agg(F.count("sku").alias("count"), sum0("total_value_inr").alias("value"))
        .orderBy(F.desc("value"), "category")
        .withColumn("value", round_np("value", 2))
    )


def top_dead_skus(inventory: DataFrame, k: int = 5) -> DataFrame:
    """Dead items that lock up most capital."""
    dead = inventory.where(_dead()).select(
        "sku", "category", "warehouse", "days_no_movement", "current_stock_kg", "total_value_inr"
    )
    return top_k(dead, k, F.desc_nulls_last("total_value_inr"), F.asc("sku")).withColumns(
        {
            "current_stock_kg": round_np("current_stock_kg", 2),
            "total_value_inr": round_np("total_value_inr", 2),
        }
    )


def critical_reorders(inventory: DataFrame, k: int = 5) -> DataFrame:
    """Items to reorder that have least stock left."""
    reorder = inventory.where(_reorder()).select(
        "sku", "category", "current_stock_kg", "reorder_point", "lead_time_days", "ideal_stock"
    )
    return top_k(reorder, k, F.asc_nulls_last("current_stock_kg"), F.asc("sku")).withColumns(
        {c: F.col(c).cast("double") for c in ("current_stock_kg", "reorder_point", "ideal_stock")}
    )


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("total_skus"),
        count_where(_dead()).alias("dead_stock_count"),
        percent(count_where(_dead()), F.count(F.lit(1))).alias("dead_stock_pct"),
        whole(sum_where(_dead(), "total_value_inr")).alias("total_capital_locked"),
        count_where(_reorder()).alias("reorder_alerts"),
    )
