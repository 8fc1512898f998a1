"""Tax invoices: mismatches, suppliers at risk, trend. Outlier flags are in ``isolation``.

Lines become additive measures first, so every operator takes lines and any rollup of them alike.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizmetrics.functions.numeric import keyed, percent, round_np, sum0, whole
from bizmetrics.functions.ordering import top_k
from bizmetrics.operators.isolation import FEATURES


def _mismatch() -> Column:
    return F.col("mismatch_flag") == 1


MEASURES = ("lines", "mismatches", "flags", "numbered_mismatches", "tax_at_risk", "complete")
ROLLUP_KEYS = ("return_period", "counterparty_id", "counterparty_name", "mismatch_reason")


def tax_measures(gst: DataFrame) -> DataFrame:
    """Add those measures whose columns are there; a rollup passes through unchanged."""
    have = set(gst.columns)
    if "lines" in have:
        return gst
    added: dict[str, Column] = {"lines": F.lit(1).cast("bigint")}
    if "mismatch_flag" in have:
        mismatch = F.coalesce(_mismatch(), F.lit(False))
        added |= {"mismatches": mismatch.cast("bigint"), "flags": F.col("mismatch_flag")}
        if "invoice_no" in have:
            added["numbered_mismatches"] = (mismatch & F.col("invoice_no").isNotNull()).cast("bigint")
        if "total_tax_amount" in have:
            added["tax_at_risk"] = F.when(mismatch, F.col("total_tax_amount"))
    if set(FEATURES) <= have:  # lines that the outlier forest scores
        known = [F.nanvl(F.col(c).cast("double"), F.lit(None)).isNotNull() for c in FEATURES]
        added["complete"] = reduce(and_, known).cast("bigint")
    return gst.withColumns(added)


def tax_rollup(gst: DataFrame, *keys: str) -> DataFrame:
    """Measures per key (default: period, supplier and reason); missing keys stay a group of their own."""
    measures = tax_measures(gst)
    have = set(measures.columns)
    return measures.groupBy(*keys or ROLLUP_KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES if m in have])


def _mismatched(gst: DataFrame) -> DataFrame:
    """Measures of mismatched lines; on lines the condition reaches the scan."""
    if "lines" in gst.columns:
        return gst.where("mismatches > 0")
    return tax_measures(gst.where(_mismatch()))


def mismatch_reasons(gst: DataFrame) -> DataFrame:
    return (
        keyed(_mismatched(gst), "mismatch_reason")
        .groupBy("mismatch_reason")
        .agg(F.sum("mismatches").alias("invoices"))
    )


def supplier_risk(gst: DataFrame, k: int = 5) -> DataFrame:
    """Suppliers with most tax credit in mismatched invoices."""
    suppliers = (
        keyed(_mismatched(gst), "counterparty_id", "counterparty_name")
        .groupBy("counterparty_id", "counterparty_name")
        .agg(F.sum("numbered_mismatches").alias("invoice_count"), sum0("tax_at_risk").alias("total_itc_risk"))
    )
    order = (F.desc("total_itc_risk"), F.asc("counterparty_id"), F.asc("counterparty_name"))
    return top_k(suppliers, k, *order).withColumn("total_itc_risk", round_np("total_itc_risk", 2))


def mismatch_trend(gst: DataFrame, periods: int = 6) -> DataFrame:
    """Mismatches of the last periods, those without any included. Periods are ``yyyy-MM`` text."""
    per_period = (
        keyed(tax_measures(gst), "return_period").groupBy("return_period").agg(whole(sum0("flags")).alias("mismatches"))
    )
    return per_period.orderBy(F.desc("return_period")).limit(periods).orderBy("return_period")


def tax_totals(gst: DataFrame) -> DataFrame:
    return tax_measures(gst).agg(
        sum0("lines").cast("bigint").alias("total_invoices"),
        sum0("mismatches").cast("bigint").alias("total_mismatches"),
        percent(F.sum("mismatches"), F.sum("lines")).alias("mismatch_pct"),
        whole(sum0("tax_at_risk")).alias("total_itc_at_risk"),
    )
