import datetime as dt
from decimal import Decimal

import pytest

from bizmetrics.operators import cashflow

SCHEMA = (
    "invoice_no string, customer_id string, customer_name string, region string, invoice_amount decimal(18,4),"
    " invoice_date date, due_date date, received_date date, days_overdue int, aging_bucket string"
)


def invoices(spark, rows):
    base = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")])
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], SCHEMA)


def test_bucket_edges(spark):
    edges = {
        -1000: None, -999: None, -998: 0, 0: 0, 1: 1, 30: 1, 31: 2, 60: 2, 61: 3, 90: 3, 91: 4, 9999: 4, 10000: None,
        None: None,
    }
    df = invoices(spark, [{"invoice_no": str(d), "days_overdue": d, "invoice_amount": Decimal(100)} for d in edges])
    rows = {r.days_overdue: r for r in cashflow.expected_inflow(df).collect()}
    chance = {0: "0.98", 1: "0.92", 2: "0.70", 3: "0.45", 4: "0.20", None: None}
    for days, bucket in edges.items():
        assert rows[days].bucket == bucket
        want = chance[bucket]
        assert rows[days].exp_inflow == (None if want is None else Decimal(want) * 100)


def test_double_amounts_work_too(spark):
    df = spark.createDataFrame([(10.0, 5)], "invoice_amount double, days_overdue int")
    assert cashflow.expected_inflow(df).first().exp_inflow == pytest.approx(9.2)


def test_slow_payers_skip_missing_keys_and_count_numbered_invoices(spark):
    df = invoices(
        spark,
        [
            {"customer_id": "a", "customer_name": "A", "invoice_no": "1", "invoice_amount": Decimal(10), "days_overdue": 1},
            {"customer_id": "a", "customer_name": "A", "invoice_amount": Decimal(5), "days_overdue": 2},
            {"customer_id": "b", "customer_name": None, "invoice_no": "3", "invoice_amount": Decimal(99), "days_overdue": 9},
            {"customer_id": "c", "customer_name": "C", "invoice_no": "4", "invoice_amount": None, "days_overdue": 9},
            {"customer_id": "d", "customer_name": "D", "invoice_no": "5", "invoice_amount": Decimal(50), "days_overdue": 0},
        ],
    )
    rows = cashflow.slow_payers(df).orderBy("rank").collect()
    assert [(r.customer_id, r.total_overdue, r.invoice_count, r.avg_days_late) for r in rows] == [
        ("a", 15.0, 1, 1.5),
        ("c", 0.0, 1, 9.0),
    ]


def test_totals(spark):
    day = dt.date
    df = invoices(
        spark,
        [
            {"customer_id": "a", "invoice_amount": Decimal("10.9"), "days_overdue": 5, "invoice_date": day(2024, 1, 1), "received_date": day(2024, 1, 11)},
            {"customer_id": None, "invoice_amount": Decimal("1.05"), "days_overdue": 5, "aging_bucket": "Bad Debt"},
            {"customer_id": "b", "invoice_amount": Decimal("3"), "days_overdue": -5, "invoice_date": day(2024, 1, 1), "received_date": day(2024, 1, 2)},
        ],
    )
    row = cashflow.cashflow_totals(df).first()
    assert row.asDict() == {
        "total_overdue": 11,
        "expected_30d_inflow": 13,  # 10.9*.92 + 1.05*.92 + 3*.98
        "overdue_invoice_count": 2,
        "slow_payer_count": 1,
        "dso_days": 5.5,
        "bad_debt_amount": 1,
    }


def test_totals_of_nothing(spark):
    row = cashflow.cashflow_totals(invoices(spark, [])).first()
    assert row.total_overdue == 0 and row.overdue_invoice_count == 0 and row.dso_days is None


@pytest.mark.parametrize(
    "invoiced, received, days",
    [
        ("2024-01-01 23:00:00", "2024-01-02 01:00:00", 0.0),
        ("2024-01-01 01:00:00", "2024-01-03 02:00:00", 2.0),
        ("2024-01-02 01:00:00", "2024-01-01 23:00:00", -1.0),
        ("2024-01-03 00:00:00", "2024-01-01 00:00:00", -2.0),
    ],
)
def test_timestamps_count_elapsed_days(spark, invoiced, received, days):
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.sql(
            f"""select 'a' customer_id, 1.0D invoice_amount, 1 days_overdue, 'x' aging_bucket,
                 cast('{invoiced}' as {kind}) invoice_date, cast('{received}' as {kind}) received_date"""
        )
        assert cashflow.cashflow_totals(df).first().dso_days == days


def test_counts_drop_missing_keys(spark):
    df = invoices(
        spark,
        [
            {"aging_bucket": None, "region": None, "invoice_amount": Decimal(1), "days_overdue": 1},
            {"aging_bucket": "1-30", "region": "R", "invoice_amount": Decimal(2), "days_overdue": 1},
        ],
    )
    assert [tuple(r) for r in cashflow.aging_counts(df).collect()] == [("1-30", 1)]
    assert [tuple(r) for r in cashflow.overdue_by_region(df).collect()] == [("R", 2.0)]
