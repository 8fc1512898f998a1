"""The four business tables: column names and types."""

from __future__ import annotations

from pyspark.sql.types import DateType, DecimalType, DoubleType, IntegerType, StringType, StructField, StructType

MONEY = DecimalType(18, 4)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


SALES = _table(
    date=DateType(),
    product_id=StringType(),
    product_name=StringType(),
    customer_id=StringType(),
    customer_name=StringType(),
    region=StringType(),
    revenue=MONEY,
    quantity_sold=DoubleType(),
    margin_pct=DoubleType(),
    discount_pct=DoubleType(),
    returns_qty=DoubleType(),
    is_festive=IntegerType(),
)

RECEIVABLES = _table(
    invoice_no=StringType(),
    customer_id=StringType(),
    customer_name=StringType(),
    region=StringType(),
    invoice_amount=MONEY,
    invoice_date=DateType(),
    due_date=DateType(),
    received_date=DateType(),
    days_overdue=IntegerType(),
    aging_bucket=StringType(),
)

INVENTORY = _table(
    sku=StringType(),
    category=StringType(),
    warehouse=StringType(),
    days_no_movement=IntegerType(),
    current_stock_kg=DoubleType(),
    total_value_inr=MONEY,
    lead_time_days=IntegerType(),
    reorder_point=DoubleType(),
    ideal_stock=DoubleType(),
    is_dead_stock=IntegerType(),
    needs_reorder=IntegerType(),
)

GST = _table(
    invoice_no=StringType(),
    counterparty_id=StringType(),
    counterparty_name=StringType(),
    return_period=StringType(),
    taxable_value=MONEY,
    cgst_amount=MONEY,
    sgst_amount=MONEY,
    total_tax_amount=MONEY,
    mismatch_flag=IntegerType(),
    mismatch_reason=StringType(),
)

TABLES = {"sales": SALES, "receivables": RECEIVABLES, "inventory": INVENTORY, "gst": GST}
