import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bizmetrics.functions.numeric import mean, percent, ratio, round_float, round_np, sum0, whole
from bizmetrics.functions.ordering import exact_quantile, top_k, with_position


def test_round_half_even_like_numpy(spark):
    values = [12.45, 0.25, 2.675, 0.35, -0.25, -12.45, 0.0, 1e9 + 0.125]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(round_np("v", digits)).collect()]
        assert got == [float(np.round(v, digits)) for v in values]


def test_round_exact_binary_value_like_python(spark):
    values = [k / n * 100 for n in (2000, 4000, 1999) for k in range(n + 1)] + [i * 0.05 for i in range(-3000, 3000)]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = df.select("v", round_float("v", 1).alias("r"), F.format_string("%.1f", round_float("v", 1)).alias("t")).toPandas()
    assert got["r"].tolist() == [round(v, 1) for v in got["v"]]
    # Java prints -0.0 as Python does
    assert got["t"].tolist() == [f"{v:.1f}" for v in got["v"]]


def test_sums_and_means_of_nothing(spark):
    empty = spark.createDataFrame([], "v decimal(18,4), n bigint")
    row = empty.agg(
        sum0("v").alias("s"), mean("v").alias("m"), percent(F.count("v"), F.count(F.lit(1))).alias("p")
    ).first()
    assert row.s == 0 and row.m is None and row.p is None


def test_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double")
    assert df.agg(mean("v")).first()[0] == 2.5
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0))).first()[0] is None


def test_whole_truncates_towards_zero(spark):
    df = spark.createDataFrame([(2.9,), (-2.9,)], "v double")
    assert [r[0] for r in df.select(whole("v")).collect()] == [2, -2]


@pytest.mark.parametrize("q", [0.0, 0.12, 0.5, 0.999, 1.0])
@pytest.mark.parametrize("kind", ["uniform", "copies", "constant", "one", "two", "close"])
def test_exact_quantile_equals_numpy(spark, q, kind):
    rng = np.random.default_rng(7)
    values = {
        "uniform": rng.uniform(-1, 1, 5000),
        # one value holds a third of all rows
        "copies": np.concatenate([rng.normal(size=2000), np.full(1000, 0.25)]),
        "constant": np.full(50, -0.5),
        "one": np.array([3.0]),
        "two": np.array([1.0, 2.0]),
        "close": 1.0 + np.arange(200) * 2.0**-52,
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got, n = exact_quantile(df, "v", q, bins=16)
    assert n == len(values)
    assert got == pytest.approx(np.percentile(values, 100 * q), rel=1e-12, abs=1e-15)


def test_exact_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([], "v double"), "v", 0.5) == (None, 0)
    assert exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) == (None, 0)


def test_positions_follow_the_global_order(spark):
    rng = np.random.default_rng(3)
    # the hot key holds a third of all rows
    keys = np.where(rng.random(6000) < 1 / 3, 500, rng.integers(0, 1000, 6000))
    pdf = pd.DataFrame({"a": keys, "b": rng.permutation(6000)})
    df = spark.createDataFrame(pdf).repartition(13)
    got = with_position(df, "a", "b").toPandas().sort_values("position")
    want = pdf.sort_values(["a", "b"])
    assert got["position"].tolist() == list(range(1, 6001))
    assert got[["a", "b"]].to_numpy().tolist() == want[["a", "b"]].to_numpy().tolist()


def test_positions_of_nothing(spark):
    assert with_position(spark.createDataFrame([], "a int"), "a").collect() == []


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2), ("d", 0)], "k string, v int")
    rows = top_k(df, 3, F.desc("v"), F.asc("k")).orderBy("rank").collect()
    assert [(r.k, r["rank"]) for r in rows] == [("c", 1), ("a", 2), ("b", 3)]
