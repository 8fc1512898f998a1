"""All SQL queries again where one part, supplier and customer hold a third of the rows each,
with broadcasting off and skew handling forced, as a large cluster would run them."""

import duckdb
import pytest
from compare import TABLE_NAMES, duckdb_result, spark_result

import __spark_entry__ as driver

ORACLE = driver.oracle_sql()
QUERIES = driver.queries()

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


@pytest.fixture(scope="module")
def skewed(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    changed = {
        "lineitem": "select * replace (case when hash(l_orderkey, l_linenumber) % 3 = 0 then 7 else l_partkey end as l_partkey,"
        " case when hash(l_linenumber, l_orderkey) % 3 = 1 then 3 else l_suppkey end as l_suppkey) from t",
        "orders": "select * replace (case when hash(o_orderkey) % 3 = 0 then 5 else o_custkey end as o_custkey) from t",
    }
    for name in TABLE_NAMES:
        source = f"(select * from '{small}/{name}.parquet')"
        query = changed.get(name, "select * from t").replace("from t", f"from {source}")
        con.execute(f"copy ({query}) to '{folder}/{name}.parquet' (format parquet)")
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield str(folder)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - {"answers", "report_headlines", "report_lists", "panel_encodings"}))
def test_skewed_tables_give_the_same_rows(spark, skewed, name):
    assert spark_result(QUERIES[name](spark, skewed)) == duckdb_result(skewed, ORACLE[name])
