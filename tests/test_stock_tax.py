from decimal import Decimal

from bizmetrics.operators import inventory, tax

STOCK = (
    "sku string, category string, warehouse string, days_no_movement int, current_stock_kg double,"
    " total_value_inr decimal(18,4), lead_time_days int, reorder_point double, ideal_stock double,"
    " is_dead_stock int, needs_reorder int"
)
GST = (
    "invoice_no string, counterparty_id string, counterparty_name string, return_period string,"
    " total_tax_amount decimal(18,4), mismatch_flag int, mismatch_reason string"
)


def test_ties_and_missing_values_in_lists(spark):
    rows = [
        ("s3", "A", "W", 1, 5.0, Decimal("10.005"), 1, 1.23456, 2.0, 1, 1),
        ("s1", "A", "W", 1, 5.0, Decimal("10.005"), 1, 1.0, 2.0, 1, 1),
        ("s2", None, "W", 1, None, None, 1, 1.0, 2.0, 1, 1),
        ("s4", "B", "W", 1, 1.0, Decimal("99"), 1, 1.0, 2.0, 0, 0),
    ]
    df = spark.createDataFrame(rows, STOCK)
    dead = inventory.top_dead_skus(df).orderBy("rank").collect()
    assert [(r.sku, r.total_value_inr) for r in dead] == [("s1", 10.01), ("s3", 10.01), ("s2", None)]
    reorder = inventory.critical_reorders(df).orderBy("rank").collect()
    assert [(r.sku, r.reorder_point) for r in reorder] == [("s1", 1.0), ("s3", 1.23456), ("s2", 1.0)]
    assert [tuple(r) for r in inventory.dead_by_category(df).collect()] == [("A", 2, 20.01)]
    totals = inventory.inventory_totals(df).first()
    assert tuple(totals) == (4, 3, 75.0, 20, 3)


def test_empty_stock_and_tax(spark):
    assert tuple(inventory.inventory_totals(spark.createDataFrame([], STOCK)).first()) == (0, 0, None, 0, 0)
    assert tuple(tax.tax_totals(spark.createDataFrame([], GST)).first()) == (0, 0, None, 0)


def test_tax(spark):
    rows = [("1", "s", "S", "2024-01", Decimal("10.5"), 1, "a"), ("2", "s", "S", "2024-02", Decimal("1"), 0, "a")]
    rows += [("3", None, "S", "2024-02", Decimal("5"), 1, None), (None, "t", "T", None, Decimal("7"), 1, "b")]
    rows += [(str(m), "u", "U", f"2023-{m:02d}", None, None, None) for m in range(6, 12)]
    df = spark.createDataFrame(rows, GST)
    assert {tuple(r) for r in tax.mismatch_reasons(df).collect()} == {("a", 1), ("b", 1)}
    risk = tax.supplier_risk(df).orderBy("rank").collect()
    assert [(r.counterparty_id, r.invoice_count, r.total_itc_risk) for r in risk] == [("s", 1, 10.5), ("t", 0, 7.0)]
    assert [tuple(r) for r in tax.mismatch_trend(df).collect()] == [
        ("2023-08", 0), ("2023-09", 0), ("2023-10", 0), ("2023-11", 0), ("2024-01", 1), ("2024-02", 1),
    ]
    assert tuple(tax.tax_totals(df).first()) == (10, 3, 30.0, 22)
