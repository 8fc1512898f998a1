"""Receivables: aging, expected inflow, slow payers, days to payment.

Invoices become additive measures first, so every operator takes invoices and any rollup of them alike, and one pass over the
invoices serves them all.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from bizmetrics.functions.distinct import distinct_counts, distinct_rollup
from bizmetrics.functions.numeric import keyed, ratio, round_np, sum0, whole
from bizmetrics.functions.ordering import top_k

# Right-closed bucket bounds in days, and the collection probability per bucket.
BUCKET_BOUNDS = (-999, 0, 30, 60, 90, 9999)
PROBABILITIES = (Decimal("0.98"), Decimal("0.92"), Decimal("0.70"), Decimal("0.45"), Decimal("0.20"))


def _late() -> Column:
    return F.col("days_overdue") > 0


def _by_bucket(values, bounds) -> Column:
    """Value of the right-closed bucket days_overdue falls in; missing outside all of them."""
    days = F.col("days_overdue")
    choice = F.when(days <= bounds[0], F.lit(None))
    for bound, value in zip(bounds[1:], values):
        choice = choice.when(days <= bound, F.lit(value))
    return choice


def expected_inflow(receivables: DataFrame, bounds=BUCKET_BOUNDS, probabilities=PROBABILITIES) -> DataFrame:
    """Add the aging bucket (0..n-1), its collection probability and amount x probability."""
    return receivables.withColumns(
        {
            "bucket": _by_bucket(range(len(probabilities)), bounds).cast("int"),
            "cprob": _by_bucket(probabilities, bounds),
        }
    ).withColumn("exp_inflow", F.col("invoice_amount") * F.col("cprob"))


MEASURES = ("invoices", "amount", "inflow", "late", "late_numbered", "late_amount", "late_days", "paid", "payment_days")
ROLLUP_KEYS = ("customer_id", "customer_name", "region", "aging_bucket")


def invoice_measures(receivables: DataFrame, bounds=BUCKET_BOUNDS, probabilities=PROBABILITIES) -> DataFrame:
    """Add those measures whose columns are there; a rollup passes through unchanged."""
    have = set(receivables.columns)
    if "invoices" in have:
        if (bounds, probabilities) != (BUCKET_BOUNDS, PROBABILITIES):
            raise ValueError("give the bounds to the rollup; its invoices' days are gone")
        return receivables
    added: dict[str, Column] = {"invoices": F.lit(1).cast("bigint")}
    if "invoice_amount" in have:
        added["amount"] = F.col("invoice_amount")
    if "days_overdue" in have:
        late = F.coalesce(_late(), F.lit(False))
        added |= {"late": late.cast("bigint"), "late_days": F.when(late, F.col("days_overdue").cast("bigint"))}
        if "invoice_no" in have:
            added["late_numbered"] = (late & F.col("invoice_no").isNotNull()).cast("bigint")
        if "invoice_amount" in have:
            added |= {
                "late_amount": F.when(late, F.col("invoice_amount")),
                "inflow": F.col("invoice_amount") * _by_bucket(probabilities, bounds),
            }
    if {"received_date", "invoice_date"} <= have:
        days = _payment_days(receivables).cast("bigint")
        added |= {"payment_days": days, "paid": days.isNotNull().cast("bigint")}
    return receivables.withColumns(added)


def invoice_rollup(receivables: DataFrame, *keys: str, **options) -> DataFrame:
    """Measures per key (default: customer, region and aging bucket); missing keys stay a group of their own."""
    measures = invoice_measures(receivables, **options)
    have = set(measures.columns)
    return measures.groupBy(*keys or ROLLUP_KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES if m in have])


def _late_measures(receivables: DataFrame) -> DataFrame:
    """Measures of late invoices; on invoices the condition reaches the scan."""
    if "invoices" in receivables.columns:
        return receivables.where("late > 0")
    return invoice_measures(receivables.where(_late()))


def slow_payers(receivables: DataFrame, k: int = 5) -> DataFrame:
    """Customers that owe most in overdue invoices."""
    customers = (
        keyed(_late_measures(receivables), "customer_id", "customer_name")
        .groupBy("customer_id", "customer_name")
        .agg(
            sum0("late_amount").alias("total_overdue"),
            F.sum("late_numbered").alias("invoice_count"),
            ratio(F.sum("late_days"), F.sum("late")).alias("avg_days_late"),
        )
    )
    return top_k(customers, k, F.desc("total_overdue"), F.asc("customer_id"), F.asc("customer_name")).withColumns(
        {
            "total_overdue": round_np("total_overdue", 2),
            "avg_days_late": round_np("avg_days_late", 2),
        }
    )


def late_customer_rollup(receivables: DataFrame, *keys: str) -> DataFrame:
    """Customers with late invoices per key, as bitmaps that add up; ``late_customers`` counts them."""
    late = {"slow_payer_count": F.coalesce(_late(), F.lit(False)) & F.col("customer_id").isNotNull()}
    return distinct_rollup(receivables, list(keys), "customer_id", late)


def late_customers(rollup: DataFrame, *by: str | Column) -> DataFrame:
    return distinct_counts(rollup, ["slow_payer_count"], *by)


def aging_counts(receivables: DataFrame) -> DataFrame:
    invoices = keyed(invoice_measures(receivables), "aging_bucket")
    return invoices.groupBy("aging_bucket").agg(F.sum("invoices").alias("invoices"))


def overdue_by_region(receivables: DataFrame) -> DataFrame:
    """Overdue amount per region, highest first."""
    return (
        keyed(_late_measures(receivables), "region")
        .groupBy("region")
        .agg(sum0("late_amount").alias("overdue"))
        .orderBy(F.desc("overdue"), "region")
        .withColumn("overdue", round_np("overdue", 2))
    )


def _payment_days(receivables: DataFrame) -> Column:
    """Whole days from invoice to receipt: date difference, or floored elapsed time for timestamps."""
    kinds = {f.name: f.dataType for f in receivables.schema.fields}
    if isinstance(kinds["received_date"], (TimestampType, TimestampNTZType)):
        gap = "(cast(received_date as timestamp_ntz) - cast(invoice_date as timestamp_ntz))"
        days = f"extract(day from {gap})"
        return F.expr(f"{days} - case when {gap} < make_dt_interval({days}) then 1 else 0 end")
    return F.datediff("received_date", "invoice_date")


def cashflow_totals(
    receivables: DataFrame, bounds=BUCKET_BOUNDS, probabilities=PROBABILITIES, bad_debt: str = "Bad Debt"
) -> DataFrame:
    """All scalar results in one pass. Expected inflow covers every row, paid ones included."""
    rows = invoice_measures(receivables, bounds, probabilities)
    bad = F.when(F.col("aging_bucket") == bad_debt, F.col("amount"))
    return rows.agg(
        whole(sum0("late_amount")).alias("total_overdue"),
        whole(sum0("inflow")).alias("expected_30d_inflow"),
        sum0("late").cast("bigint").alias("overdue_invoice_count"),
        F.countDistinct(F.when(F.col("late") > 0, F.col("customer_id"))).alias("slow_payer_count"),
        round_np(ratio(F.sum("payment_days"), F.sum("paid")), 1).alias("dso_days"),
        whole(sum0(bad)).alias("bad_debt_amount"),
    )
