"""Lines as additive measures.

A mean cannot be averaged again, but a sum and a count can be added again. Sales lines
are therefore turned into additive measures once; every sales operator accepts lines and
any rollup of them alike, and several reports can share one pass over the lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import new_table
from bizmetrics.functions.numeric import sum0

# Margin bounds in percent.
PROMOTE_ABOVE = 12.0
DISCONTINUE_BELOW = 4.0

_COMBINE = {
    "revenue": sum0,
    "quantity_sold": sum0,
    "returns_qty": sum0,
    "is_festive": F.max,
    "margin_sum": F.sum,
    "margin_n": F.sum,
    "margin_min": F.min,
    "discount_sum": F.sum,
    "discount_n": F.sum,
    "promote": F.max,
    "discontinue": F.max,
    "renegotiate": F.max,
}


def decision_of(margin, promote_above: float = PROMOTE_ABOVE, discontinue_below: float = DISCONTINUE_BELOW) -> Column:
    """Promote above one bound, Discontinue below the other; both bounds and a missing margin renegotiate."""
    margin = F.nanvl(F.col(margin).cast("double"), F.lit(None)) if isinstance(margin, str) else margin
    return (
        F.when(margin > F.lit(promote_above), F.lit("Promote"))
        .when(margin < F.lit(discontinue_below), F.lit("Discontinue"))
        .otherwise(F.lit("Renegotiate"))
    )


def as_measures(
    sales: DataFrame, promote_above: float = PROMOTE_ABOVE, discontinue_below: float = DISCONTINUE_BELOW
) -> DataFrame:
    """Add the additive forms of the percentage columns; rollups pass through unchanged.

    A rollup has lost the margins of its lines, so it keeps the bounds it was made with: others are an error.
    """
    have = set(sales.columns)
    if have & {"margin_sum", "discount_sum"} and not have & {"margin_pct", "discount_pct"}:
        if (promote_above, discontinue_below) != (PROMOTE_ABOVE, DISCONTINUE_BELOW):
            raise ValueError("give the bounds to the rollup; its lines' margins are gone")
        return sales
    added: dict[str, Column] = {}
    if "margin_pct" in have:
        decision = decision_of("margin_pct", promote_above, discontinue_below)
        added |= {
            "margin_sum": F.col("margin_pct"),
            "margin_n": F.col("margin_pct").isNotNull().cast("bigint"),
            "margin_min": F.col("margin_pct"),
            "promote": (decision == "Promote").cast("int"),
            "discontinue": (decision == "Discontinue").cast("int"),
            "renegotiate": (decision == "Renegotiate").cast("int"),
        }
    if "discount_pct" in have:
        added |= {
            "discount_sum": F.col("discount_pct"),
            "discount_n": F.col("discount_pct").isNotNull().cast("bigint"),
        }
    return sales.withColumns(added) if added else sales


def rollup(sales: DataFrame, *keys: str, **bounds: float) -> DataFrame:
    """Combine sales lines (or a finer rollup) per key; missing keys stay a group of their own."""
    measures = as_measures(sales, **bounds)
    have = set(measures.columns)
    return measures.groupBy(*keys).agg(
        *[combine(name).alias(name) for name, combine in _COMBINE.items() if name in have]
    )


PRODUCT_KEYS = ("date", "product_id", "product_name", "region")
CUSTOMER_KEYS = ("customer_id", "customer_name")
PROMOTABLE_KEYS = ("product_name", "margin_pct")


@dataclass(frozen=True)
class SalesRollups:
    """What the sales results start from: additive measures per date, product and region, and per customer, and the
    first date on which each product had a line to promote at each margin."""

    products: DataFrame
    customers: DataFrame
    promotable: DataFrame


def sales_rollups(sales: DataFrame, path: str | None = None, **bounds: float) -> SalesRollups:
    """All three rollups from one pass over the lines, written to ``path`` (default: the checkpoint folder).

    Grouping sets copy a line once per rollup inside its task, after it was scanned and joined, and combine the copies before the
    one shuffle. Lines that are not to be promoted are one group in the third, which is left out.
    """
    measures = as_measures(sales.withColumn("date", F.to_date("date")), **bounds)
    measures = measures.withColumns(
        {
            "_name": F.when(F.col("promote") == 1, F.col("product_name")),
            "_margin": F.when(F.col("promote") == 1, F.col("margin_pct")),
            "_date": F.when(F.col("promote") == 1, F.col("date")),
        }
    )
    sets = [[F.col(c) for c in PRODUCT_KEYS], [F.col(c) for c in CUSTOMER_KEYS], [F.col("promote"), F.col("_name"), F.col("_margin")]]
    combined = [combine(name).alias(f"sum_{name}") for name, combine in _COMBINE.items()]
    number = F.when(F.grouping("promote") == 0, F.lit("promotable")).when(F.grouping("customer_id") == 0, F.lit("customers"))
    every = list(dict.fromkeys((*PRODUCT_KEYS, *CUSTOMER_KEYS, "promote", "_name", "_margin")))
    grouped = measures.groupingSets(sets, *every).agg(
        number.otherwise(F.lit("products")).alias("_rollup"), F.min("_date").alias("_first_date"), *combined
    )
    path = path or new_table(sales.sparkSession)
    _write(grouped.where("_rollup <> 'promotable' or promote = 1").drop("promote"), path)
    return read_sales_rollups(sales.sparkSession, path)


def write_sales_rollups(rollups: SalesRollups, path: str) -> None:
    """Save rollups as ``sales_rollups`` does."""
    named = {m: f"sum_{m}" for m in _COMBINE}
    own = {"product_name": "_name", "margin_pct": "_margin", "first_date": "_first_date"}
    tables = (
        rollups.products.withColumnsRenamed(named).withColumn("_rollup", F.lit("products")),
        rollups.customers.withColumnsRenamed(named).withColumn("_rollup", F.lit("customers")),
        rollups.promotable.withColumnsRenamed(own).withColumn("_rollup", F.lit("promotable")),
    )
    _write(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables), path)


def _write(rows: DataFrame, path: str) -> None:
    """Sorted, so that a reader of one rollup skips the others' row groups."""
    rows.sortWithinPartitions("_rollup").write.parquet(path)


def read_sales_rollups(spark: SparkSession, path: str) -> SalesRollups:
    """What ``sales_rollups`` wrote to ``path``."""
    written = spark.read.parquet(path)

    def part(name: str, *wanted: str) -> DataFrame:
        return written.where(F.col("_rollup") == name).select(*wanted, *[F.col(f"sum_{m}").alias(m) for m in _COMBINE])

    promotable = written.where(F.col("_rollup") == "promotable").select(
        F.col("_name").alias("product_name"), F.col("_margin").alias("margin_pct"), F.col("_first_date").alias("first_date")
    )
    return SalesRollups(part("products", *PRODUCT_KEYS), part("customers", *CUSTOMER_KEYS), promotable)


def merge_sales_rollups(parts: list[SalesRollups]) -> SalesRollups:
    """Rollups of several sets of lines as one, not yet written."""

    def union(name: str) -> DataFrame:
        first, *rest = [getattr(p, name) for p in parts]
        for other in rest:
            first = first.unionByName(other)
        return first

    if len(parts) == 1:
        return parts[0]
    return SalesRollups(
        products=rollup(union("products"), *PRODUCT_KEYS),
        customers=rollup(union("customers"), *CUSTOMER_KEYS),
        promotable=union("promotable").groupBy(*PROMOTABLE_KEYS).agg(F.min("first_date").alias("first_date")),
    )
