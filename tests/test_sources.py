import datetime as dt
from decimal import Decimal

import pytest
from plans import scans
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bizmetrics.plans.report import load_report, rejected_fields
from bizmetrics.sources import star
from bizmetrics.sources.files import MISSING, csv_headers, csv_rejects, read_csv, read_parquet, stage_csv
from bizmetrics.sources.schemas import TABLES


@pytest.fixture
def receivables_csv(tmp_path):
    path = tmp_path / "receivables.csv"
    path.write_text(
        "extra,invoice_no,customer_id,customer_name,region,invoice_amount,invoice_date,due_date,received_date,days_overdue,aging_bucket\n"
        'x,A1,C1,"Shah, Sons",West,100.5,2024-01-01,2024-01-31,2024-02-10,10,1-30\n'
        "x,A2,C1,NA,null,N/A,2024-01-05 00:00:00,2024-02-04,,12.0,NaN\n"
        "x,A3,C2,B,East,oops,not a date,2024-02-04,NaN,-3,Current\n"
    )
    return str(path)


def test_csv_missing_tokens_and_types(spark, receivables_csv):
    df = read_csv(spark, receivables_csv, "receivables")
    assert df.schema == TABLES["receivables"]
    first, second, third = df.orderBy("invoice_no").collect()
    assert first.customer_name == "Shah, Sons"
    assert first.invoice_amount == Decimal("100.5000") and first.received_date == dt.date(2024, 2, 10)
    assert second.customer_name is None and second.region is None and second.aging_bucket is None
    assert second.invoice_amount is None and second.received_date is None
    assert second.days_overdue == 12 and second.invoice_date == dt.date(2024, 1, 5)
    assert third.invoice_amount is None and third.invoice_date is None and third.days_overdue == -3


def test_csv_rejects_counts_bad_fields_only(spark, receivables_csv):
    row = csv_rejects(spark, receivables_csv, "receivables").first().asDict()
    assert {k: v for k, v in row.items() if v} == {"invoice_amount": 1, "invoice_date": 1}


def test_every_missing_token_is_missing(spark, tmp_path):
    path = tmp_path / "gst.csv"
    columns = TABLES["gst"].names
    path.write_text(
        "\n".join([",".join(columns)] + [",".join([f"i{n}"] + [t] * (len(columns) - 1)) for n, t in enumerate(MISSING)])
    )
    df = read_csv(spark, str(path), "gst")
    assert df.count() == len(MISSING)
    assert df.where(" or ".join(f"{c} is not null" for c in columns[1:])).count() == 0


def test_csv_flags_and_date_format(spark, tmp_path):
    path = tmp_path / "sales.csv"
    columns = TABLES["sales"].names
    path.write_text(
        ",".join(columns)
        + "\n01/02/2024,P,N,C,N,R,1e3,NaN,12.45,1,0,True\n31/01/2024,P,N,C,N,R,-5,2,3,1,0,1.5\n"
    )
    one, two = read_csv(spark, str(path), "sales", date_format="dd/MM/yyyy").orderBy(F.desc("date")).collect()
    assert one.date == dt.date(2024, 2, 1) and one.is_festive == 1 and one.quantity_sold is None
    assert one.revenue == Decimal("1000.0000") and one.margin_pct == 12.45
    assert two.date == dt.date(2024, 1, 31) and two.is_festive is None


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "inventory.csv"
    columns = TABLES["inventory"].names
    path.write_text(",".join(columns) + '\nS1,"a\nb ""c""",W,1,2,3,4,5,6,1,False\n')
    row = read_csv(spark, str(path), "inventory", multi_line=True).first()
    assert (row.category, row.is_dead_stock, row.needs_reorder) == ('a\nb "c"', 1, 0)


def test_csv_columns_are_found_by_each_files_header(spark, tmp_path):
    (tmp_path / "t.csv").mkdir()
    (tmp_path / "t.csv/a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "t.csv/b.csv").write_text("\ufeffb,\"x\ny\",B,a,b,a\n3,0,0,4,9,9\n")
    (tmp_path / "t.csv/c.csv").write_text("a,b\n5,oops\n")
    (tmp_path / "t.csv/empty.csv").write_text("")
    schema = StructType.fromDDL("a int, b int")
    path = str(tmp_path / "t.csv")
    headers = {r.path.rsplit("/", 1)[1]: r.header for r in csv_headers(spark, path).collect()}
    assert headers == {"a.csv": ["a", "b"], "b.csv": ["b", "x\ny", "B", "a", "b", "a"], "c.csv": ["a", "b"]}
    assert {tuple(r) for r in read_csv(spark, path, schema, multi_line=True).collect()} == {(1, 2), (4, 3), (5, None)}
    (tmp_path / "t.csv/b.csv").write_text("b,c\n1,2\n")
    with pytest.raises(ValueError, match="no column a in the header of .*b.csv"):
        read_csv(spark, path, schema)
    with pytest.raises(ValueError, match="no CSV file"):
        read_csv(spark, str(tmp_path / "t.csv/empty.csv"), schema)


def test_staged_csv_names_the_lost_fields(spark, receivables_csv, tmp_path):
    folder = tmp_path / "r.csv"
    folder.mkdir()
    (folder / "one.csv").write_text(open(receivables_csv).read())
    columns = TABLES["receivables"].names[::-1]
    values = {"invoice_no": "A4", "invoice_amount": "1.23456", "days_overdue": "1.5", "due_date": "NA"}
    (folder / "two.csv").write_text(",".join(columns) + "\n" + ",".join(values.get(c, "") for c in columns) + "\n")
    staged = stage_csv(spark, str(folder), "receivables")
    lost = {(r.file.rsplit("/", 1)[1], r.column, r.text, r.reason) for r in staged.rejects.collect()}
    assert lost == {
        ("one.csv", "invoice_amount", "oops", "unreadable"),
        ("one.csv", "invoice_date", "not a date", "unreadable"),
        ("two.csv", "invoice_amount", "1.23456", "rounded"),
        ("two.csv", "days_overdue", "1.5", "unreadable"),
    }
    assert staged.counts == {"invoice_amount": 2, "invoice_date": 1, "days_overdue": 1}
    assert staged.rows.schema == TABLES["receivables"] and staged.rows.count() == 4
    assert staged.rows.where("invoice_no = 'A4'").first().invoice_amount == Decimal("1.2346")
    one = stage_csv(spark, receivables_csv, "receivables").rows
    assert one.exceptAll(read_csv(spark, receivables_csv, "receivables")).isEmpty()


def test_staging_is_one_scan(spark, receivables_csv):
    with scans(spark) as seen:
        staged = stage_csv(spark, receivables_csv, "receivables")
        staged.rejects.count()
        staged.rows.count()
    assert seen("receivables.csv", "csv") == 1


def test_unreadable_fields_are_counted_by_name(spark, receivables_csv, tmp_path):
    path = tmp_path / "receivables.csv"
    columns = TABLES["receivables"].names
    row = ["13/01/2024" if TABLES["receivables"][c].dataType.simpleString() == "date" else "1" for c in columns]
    path.write_text(",".join(columns) + "\n" + ",".join(row) + "\n")
    dates = {f"receivables.{c}": 1 for c in columns if TABLES["receivables"][c].dataType.simpleString() == "date"}
    assert rejected_fields(spark, {"receivables": str(path)}) == dates
    assert rejected_fields(spark, {"receivables": str(path)}, date_format="dd/MM/yyyy") == {}
    with pytest.raises(ValueError, match="could not be read"):
        load_report(spark, {n: str(path) for n in ("receivables",)}, str(tmp_path / "snapshot"))


def test_csv_reads_only_the_columns_used(spark, receivables_csv):
    plan = read_csv(spark, receivables_csv, "receivables").select("region")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<region:string>" in plan


def test_parquet_nan_is_missing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, b int").write.parquet(path)
    df = read_parquet(spark, path)
    assert {(r.a, r.b) for r in df.collect()} == {(None, 1), (2.0, 2)}
    assert df.where(F.col("a") > 12).count() == 0


def test_star_foreign_keys_hold(spark, small):
    """The adapters leave out joins whose columns are not asked for; that needs these keys."""
    t = {n: star.table(spark, small, n) for n in "region nation customer supplier part orders lineitem".split()}
    for child, key, parent, parent_key in [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("nation", "n_regionkey", "region", "r_regionkey"),
    ]:
        dangling = t[child].join(t[parent], F.col(key) == F.col(parent_key), "left_anti").count()
        doubled = t[parent].groupBy(parent_key).count().where("count > 1").count()
        assert (dangling, doubled) == (0, 0), (child, key)


@pytest.mark.parametrize("name", ["sales", "receivables", "inventory", "gst"])
def test_adapter_columns_do_not_depend_on_the_joins_left_out(spark, small, name):
    adapter = getattr(star, name)
    whole = adapter(spark, small)
    for column in whole.columns:
        alone = adapter(spark, small, column)
        assert alone.exceptAll(whole.select(column)).isEmpty() and alone.count() == whole.count(), column


def test_staging_casts_every_money_field_once(spark, tmp_path):
    path = tmp_path / "gst.csv"
    columns = TABLES["gst"].names
    path.write_text(",".join(columns) + "\nI1,C1,N,2024-01,1.5,0.12345,oops,NA,1,\nI2,C1,N,2024-01,1.5,1,1,1,x,R\n")
    taken = []
    original = DataFrameWriter.parquet

    def parquet(writer, *args, **kwargs):
        taken.append(writer._df._jdf.queryExecution().optimizedPlan().toString())
        return original(writer, *args, **kwargs)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", parquet)
        staged = stage_csv(spark, str(path), "gst")
    money = [f for f in TABLES["gst"].fields if f.dataType.simpleString().startswith("decimal")]
    assert taken[0].count("as decimal(18,4))") == len(money)
    lost = {(r.column, r.text, r.reason) for r in staged.rejects.collect()}
    assert lost == {("cgst_amount", "0.12345", "rounded"), ("sgst_amount", "oops", "unreadable"), ("mismatch_flag", "x", "unreadable")}
    assert staged.counts == {"cgst_amount": 1, "sgst_amount": 1, "mismatch_flag": 1}
    assert staged.rows.where("invoice_no = 'I1'").first().cgst_amount == Decimal("0.1235")
