"""The four business tables and the questions, derived from a star schema in Parquet.

Each adapter takes the columns the caller needs and joins only the tables those columns
come from. That relies on the star schema's foreign keys: every line has its order, part
and supplier, every order its customer. No join carries a broadcast hint, so Spark
broadcasts a dimension only when its measured size is under the session's threshold and
otherwise uses a sort-merge join, which AQE splits where a key is hot. Lines and orders
both grow with the data: that join is always a sort-merge join, never a broadcast. Stored by
``write_bucketed`` they join without a shuffle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-12-01"

# Naming the columns spares a job per table that would read them from the files.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
}

# Three-letter month names, in order, as they occur in question texts.
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


# Tables that grow together, and the key that joins them.
_BUCKET_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


@dataclass(frozen=True)
class BucketedStar:
    """A star schema whose lines and orders lie in the catalogue in equal buckets of the order, sorted by it.

    Give it to the adapters in place of a folder: lines meet their orders bucket by bucket, without a shuffle. The other tables are
    read from ``folder``.
    """

    folder: str
    prefix: str


def write_bucketed(spark: SparkSession, sf_dir: str, path: str, buckets: int, prefix: str | None = None) -> BucketedStar:
    """Write lines and orders once, bucketed and sorted by the order, below ``path``; tables ``<prefix>_lineitem`` and ``<prefix>_orders``.

    ``buckets`` is about the bytes of the lines / 200 MB. Rows are dealt by order first, so each bucket is one file.
    """
    prefix = prefix or f"star_{uuid.uuid4().hex[:12]}"
    for name, key in _BUCKET_KEYS.items():
        rows = table(spark, sf_dir, name).repartition(buckets, key)
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{name}").saveAsTable(f"{prefix}_{name}")
    return BucketedStar(sf_dir, prefix)


def table(spark: SparkSession, sf_dir: str | BucketedStar, name: str) -> DataFrame:
    if isinstance(sf_dir, BucketedStar):
        if name in _BUCKET_KEYS:
            return spark.table(f"{sf_dir.prefix}_{name}")
        sf_dir = sf_dir.folder
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Sales lines. Orders take their customer and region before they meet the lines,
    so the wide lineitem side is shuffled once for the order and once for the part."""
    derived = {**_order_columns(), **_product_columns(), **_line_columns()}
    need = set(columns or derived)
    lines = table(spark, sf_dir, "lineitem")
    if need & set(_order_columns()):
        lines = lines.join(_orders_for(spark, sf_dir, need), F.col("l_orderkey") == F.col("o_orderkey"))
    if need & set(_product_columns()):
        lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _pick(lines, derived, columns)


def _order_columns() -> dict[str, Column]:
    return {
        "date": F.trunc(F.col("o_orderdate").cast("date"), "month"),
        "customer_id": F.col("o_custkey"),
        "customer_name": F.col("c_name"),
        "region": F.col("r_name"),
        "is_festive": F.month("o_orderdate").isin(10, 11).cast("int"),
    }


def _product_columns() -> dict[str, Column]:
    return {"product_id": F.col("p_brand"), "product_name": F.concat(F.lit("Product "), F.col("p_brand"))}


def _line_columns() -> dict[str, Column]:
    return {
        "revenue": _net_price(),
        "quantity_sold": F.expr("cast(l_quantity as decimal(10,2))"),
        "margin_pct": F.expr(
            "cast(18 - 150*cast(l_discount as decimal(4,2)) - 50*cast(l_tax as decimal(4,2)) as decimal(10,2))"
        ),
        "discount_pct": F.expr("cast(100*cast(l_discount as decimal(4,2)) as decimal(10,2))"),
        "returns_qty": F.when(
            F.col("l_returnflag") == "R", F.expr("cast(l_quantity as decimal(10,2))")
        ).otherwise(F.expr("cast(0 as decimal(10,2))")),
    }


def _orders_for(spark: SparkSession, sf_dir: str, need: set[str]) -> DataFrame:
    """The orders side of the join with lines; both grow with the data, hence the hint."""
    return _orders(spark, sf_dir, name="customer_name" in need, region="region" in need).hint("merge")


def receivables(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One invoice per order; every tenth partly shipped order is unpaid."""
    issued = F.col("o_orderdate").cast("date")
    unpaid = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 10 == 0)
    pay = (F.lit(10) + (F.col("o_orderkey") * 37) % 140).cast("int")
    overdue = F.when(unpaid, F.datediff(F.lit(AS_OF).cast("date"), issued) - 30).otherwise(pay - 30)
    derived: dict[str, Column] = {
        "invoice_no": F.col("o_orderkey"),
        "customer_id": F.col("o_custkey"),
        "customer_name": F.col("c_name"),
        "region": F.col("r_name"),
        "invoice_amount": F.expr("cast(o_totalprice as decimal(18,2))"),
        "invoice_date": issued,
        "due_date": F.date_add(issued, 30),
        "received_date": F.when(~unpaid, F.date_add(issued, pay)),
        "days_overdue": overdue,
        "aging_bucket": F.when(overdue <= 0, "Current")
        .when(overdue <= 30, "1-30")
        .when(overdue <= 60, "31-60")
        .when(overdue <= 90, "61-90")
        .otherwise("Bad Debt"),
    }
    need = set(columns or derived)
    return _pick(
        _orders(spark, sf_dir, name="customer_name" in need, region="region" in need), derived, columns
    )


def inventory(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per part that ever moved. Lines are summed per part before the join."""
    moved = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.sum(F.expr("cast(l_quantity as decimal(10,2))")).cast("decimal(18,2)").alias("q"),
            F.max(F.col("l_shipdate").cast("date")).alias("moved"),
        )
    )
    base = (
        table(spark, sf_dir, "part")
        .join(moved, F.col("p_partkey") == F.col("l_partkey"))
        .withColumns(
            {
                "idle": F.datediff(F.lit(AS_OF).cast("date"), F.col("moved")),
                "stock": F.expr("cast(p_size*10 + p_partkey % 97 as decimal(10,2))"),
                "lead": F.expr("cast(7 + p_partkey % 24 as int)"),
            }
        )
    )
    derived: dict[str, Column] = {
        "sku": F.col("p_partkey"),
        "category": F.col("p_type"),
        "warehouse": F.concat(F.lit("WH-"), (F.col("p_partkey") % 5).cast("string")),
        "days_no_movement": F.col("idle"),
        "current_stock_kg": F.col("stock"),
        "total_value_inr": F.expr("cast(stock * cast(p_retailprice as decimal(12,2)) as decimal(18,4))"),
        "lead_time_days": F.col("lead"),
        "reorder_point": F.expr("cast(q*lead*cast(0.0025 as decimal(5,4)) as decimal(18,6))"),
        "ideal_stock": F.expr("cast(q*lead*cast(0.0050 as decimal(5,4)) as decimal(18,6))"),
        "is_dead_stock": (F.col("idle") > 180).cast("int"),
        "needs_reorder": F.expr("cast(stock < q*lead*cast(0.0025 as decimal(5,4)) as int)"),
    }
    return _pick(base, derived, columns)


def gst(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One tax row per line; the supplier is joined only when its name is asked for."""
    tax = "cast(taxable_value * cast(l_tax as decimal(4,2)) as decimal(18,6))"
    half = f"cast({tax} * cast(0.5 as decimal(2,1)) as decimal(18,7))"
    mismatch = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    derived: dict[str, Column] = {
        "invoice_no": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        "counterparty_id": F.col("l_suppkey"),
        "counterparty_name": F.col("s_name"),
        "return_period": F.date_format("l_shipdate", "yyyy-MM"),
        "taxable_value": F.col("taxable_value"),
        "cgst_amount": F.expr(half),
        "sgst_amount": F.expr(half),
        "total_tax_amount": F.expr(tax),
        "mismatch_flag": F.when(mismatch, 1).otherwise(0),
        "mismatch_reason": F.when(
            mismatch,
            F.when(F.col("l_linenumber") % 3 == 0, "Rate mismatch")
            .when(F.col("l_linenumber") % 3 == 1, "Missing in return")
            .otherwise("Value mismatch"),
        ),
    }
    lines = table(spark, sf_dir, "lineitem").withColumn("taxable_value", _net_price())
    if not columns or "counterparty_name" in columns:
        lines = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return _pick(lines, derived, columns)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question text per order, over all intents, with and without a month."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("q_id"),
        F.expr(
            f"""concat(
              element_at(array('Predict demand', 'Revenue', 'Cash flow risk', 'DSO trend', 'Low MARGIN customers',
                'Which items to discontinue', 'GST filing', 'Dead SKUs', 'Full report', 'Sales report', 'Hello there'),
                cast(o_orderkey % 11 as int) + 1),
              case o_orderkey % 3 when 0 then ''
                when 1 then concat(' in ', substr('{_MONTHS}', month(o_orderdate) * 3 - 2, 3), ' ', year(o_orderdate))
                else concat(' maybe in ', year(o_orderdate)) end)"""
        ).alias("text"),
    )


def _orders(spark: SparkSession, sf_dir: str, name: bool, region: bool) -> DataFrame:
    """Orders with the customer's name and region where asked for."""
    orders = table(spark, sf_dir, "orders")
    if name or region:
        orders = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if region:
        regions = table(spark, sf_dir, "nation").join(
            table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        orders = orders.join(regions, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders


def _net_price() -> Column:
    return F.expr(
        "cast(cast(l_extendedprice as decimal(12,2))"
        " * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2))) as decimal(18,4))"
    )


def _pick(df: DataFrame, derived: dict[str, Column], columns: tuple[str, ...]) -> DataFrame:
    return df.select(*[derived[c].alias(c) for c in columns or derived])
