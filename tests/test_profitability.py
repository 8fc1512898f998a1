import datetime as dt
from decimal import Decimal

from bizmetrics.operators import profitability as p

SCHEMA = (
    "date date, product_id string, product_name string, customer_id string, customer_name string,"
    " revenue decimal(18,4), margin_pct double, discount_pct double"
)


def lines(spark, rows):
    base = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")])
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], SCHEMA)


def test_decision_bounds(spark):
    df = lines(spark, [{"margin_pct": m} for m in (12.01, 12.0, 4.0, 3.99, None, float("nan"))])
    got = [r.decision for r in p.with_decision(df).collect()]
    assert got == ["Promote", "Renegotiate", "Renegotiate", "Discontinue", "Renegotiate", "Renegotiate"]


def test_other_bounds(spark):
    df = lines(spark, [{"margin_pct": m, "product_id": "a", "customer_id": "c"} for m in (30.0, 20.0)])
    assert tuple(p.decision_counts(df, promote_above=25.0, discontinue_below=22.0).first()) == (1, 1, 0)


def test_a_missing_id_counts_as_one_value(spark):
    df = lines(
        spark,
        [
            {"product_id": "a", "margin_pct": 20.0},
            {"product_id": "a", "margin_pct": 21.0},
            {"product_id": None, "margin_pct": 20.0},
            {"product_id": None, "margin_pct": 25.0},
            {"product_id": "b", "margin_pct": 1.0},
            {"customer_id": "c", "margin_pct": 5.0},
            {"customer_id": None, "margin_pct": 5.0},
        ],
    )
    assert tuple(p.decision_counts(df).first()) == (2, 1, 2)
    assert tuple(p.decision_counts(lines(spark, [])).first()) == (0, 0, 0)


def test_promote_list_keeps_distinct_pairs_in_date_order(spark):
    day = dt.date
    df = lines(
        spark,
        [
            {"date": day(2024, 2, 1), "product_name": "B", "margin_pct": 15.0},
            {"date": day(2024, 1, 1), "product_name": "B", "margin_pct": 15.0},
            {"date": day(2024, 1, 1), "product_name": "A", "margin_pct": 15.0},
            {"date": day(2024, 1, 1), "product_name": None, "margin_pct": 13.0},
            {"date": day(2023, 1, 1), "product_name": "C", "margin_pct": 12.0},
            {"date": day(2024, 3, 1), "product_name": "D", "margin_pct": 18.0},
        ],
    )
    rows = p.products_to_promote(df).orderBy("rank").collect()
    assert [(r.product_name, r.net_margin_pct) for r in rows] == [("A", 15.0), ("B", 15.0), (None, 13.0)]


def test_discontinue_list_has_one_row_per_name(spark):
    df = lines(
        spark,
        [
            {"product_name": "A", "margin_pct": 3.0},
            {"product_name": "A", "margin_pct": 1.0},
            {"product_name": None, "margin_pct": 2.0},
            {"product_name": "B", "margin_pct": None},
            {"product_name": "C", "margin_pct": 30.0},
        ],
    )
    rows = p.products_to_discontinue(df, 4).orderBy("rank").collect()
    assert [(r.product_name, r.net_margin_pct) for r in rows] == [("A", 1.0), (None, 2.0), ("C", 30.0), ("B", None)]


def test_margins_without_values_come_last(spark):
    df = lines(
        spark,
        [
            {"product_id": "a", "product_name": "A", "customer_id": "x", "customer_name": "X", "margin_pct": 5.0, "revenue": Decimal(1)},
            {"product_id": "a", "product_name": "A", "customer_id": "x", "customer_name": "X", "margin_pct": None, "revenue": Decimal(2)},
            {"product_id": "b", "product_name": "B", "customer_id": "y", "customer_name": "Y", "margin_pct": None, "revenue": Decimal(4)},
            {"product_id": "c", "product_name": None, "customer_id": None, "customer_name": "Z", "margin_pct": 99.0, "revenue": Decimal(8)},
        ],
    )
    assert [(r.product_id, r.avg_margin, r.total_revenue) for r in p.top_products_by_margin(df).orderBy("rank").collect()] == [("a", 5.0, 3.0), ("b", None, 4.0)]
    assert [(r.customer_id, r.avg_margin) for r in p.low_margin_customers(df).orderBy("rank").collect()] == [("x", 5.0), ("y", None)]
