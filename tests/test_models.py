import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from plans import scans
from pyspark.sql import functions as F

from bizmetrics.operators import forecast, isolation, profitability, regression, segments
from bizmetrics.plans.catalog import catalog
from bizmetrics.sources import holidays as calendar
from bizmetrics.sources import star

FEATURES = list(isolation.FEATURES)


def tax_rows(spark, n=3000, seed=5, outliers=20):
    rng = np.random.default_rng(seed)
    x = rng.normal(100, 5, (n, 4))
    x[:outliers] = rng.choice([-1, 1], (outliers, 4)) * rng.uniform(300, 900, (outliers, 4))
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf.insert(0, "id", range(n))
    return spark.createDataFrame(pdf)


def test_forest_flags_the_share_and_the_planted_outliers(spark):
    df = tax_rows(spark)
    rows = isolation.isolation_flags(df).toPandas().set_index("id")
    flagged = rows.index[rows["iso_flag"] == -1]
    assert len(flagged) <= math.ceil(0.12 * (len(rows) - 1))
    ties = (rows["iso_score"].round(12).duplicated(keep=False)).sum()
    assert len(flagged) >= math.ceil(0.12 * (len(rows) - 1)) - ties
    assert set(range(20)) <= set(flagged)
    threshold = np.percentile(-rows["iso_score"], 12)
    assert ((-rows["iso_score"] < threshold) == (rows["iso_flag"] == -1)).all()
    assert set(rows["iso_flag"]) == {-1, 1}


def test_forest_does_not_depend_on_partitions(spark):
    df = tax_rows(spark, 1000)
    one = isolation.isolation_scores(df.coalesce(1)).orderBy("id").toPandas()
    many = isolation.isolation_scores(df.repartition(17)).orderBy("id").toPandas()
    np.testing.assert_allclose(one["iso_score"], many["iso_score"], rtol=1e-12)
    other = isolation.isolation_scores(df, seed=1).orderBy("id").toPandas()
    assert (other["iso_score"] != one["iso_score"]).any()


def test_the_sample_of_a_large_table_does_not_depend_on_partitions(spark):
    """120,000 rows, more than the pool of 100 trees x 256 rows."""
    lines = spark.range(120_000).select(
        F.concat(F.lit("i"), F.col("id")).alias("invoice_no"),
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10_000)) / 100).alias(c) for i, c in enumerate(FEATURES)],
    )
    bags = []
    for parts in (1, 11):
        rows = lines.repartition(parts)
        complete = isolation._complete(rows, ["invoice_no"], FEATURES)
        sample = isolation._tree_samples(complete, ["invoice_no"], FEATURES, 120_000, 100, 256, 42)
        bags.append(sorted(map(tuple, sample.collect())))
    assert bags[0] == bags[1] and len(bags[0]) == 25_600


def test_forest_scores_equal_a_plain_walk(spark):
    """Brute force: walk every row down every tree in Python."""
    df = tax_rows(spark, 300)
    trees, psi = 10, 64
    height = 6
    grown = (
        isolation._tree_samples(isolation._complete(df, [], FEATURES), [], FEATURES, 300, trees, psi, 42)
        .groupBy("tree")
        .applyInPandas(isolation._grower(FEATURES, height, 42), isolation._TREE_SCHEMA)
        .collect()
    )
    assert len(grown) == trees

    def depth(row, tree):
        node = 0
        for _ in range(height):
            node = 2 * node + (1 if row[tree.feature[node]] <= tree.cut[node] else 2)
        return tree.path[node - (2**height - 1)]

    got = isolation.isolation_scores(df, trees=trees, sample_size=psi).orderBy("id").toPandas()
    scale = 2 * (math.log(psi - 1) + np.euler_gamma) - 2 * (psi - 1) / psi
    for _, row in got.iterrows():
        x = row[FEATURES].to_numpy()
        want = 2 ** (-np.mean([depth(x, t) for t in grown]) / scale)
        assert row["iso_score"] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("n", [300, 20_000])
def test_tree_samples_are_full_and_share_out_copies(spark, n):
    """A third of all rows are copies of one row; every tree sees about its share of them."""
    trees, psi = 10, 128
    df = spark.range(n).select(
        *[F.when(F.col("id") % 3 == 0, -1.0).otherwise(F.rand(i) * 100).alias(c) for i, c in enumerate(FEATURES)]
    )
    sample = isolation._tree_samples(isolation._complete(df, [], FEATURES), [], FEATURES, n, trees, psi, 42).toPandas()
    assert sample.groupby("tree").size().tolist() == [psi] * trees
    share = sample.assign(copy=sample[FEATURES[0]] == -1).groupby("tree")["copy"].mean()
    assert share.between(0.2, 0.47).all()


def test_forest_edges(spark):
    schema = "id int, " + ", ".join(f"{c} double" for c in FEATURES)
    assert isolation.isolation_flags(spark.createDataFrame([], schema)).count() == 0
    one = isolation.isolation_flags(spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0)], schema)).first()
    assert one.iso_flag == 1
    same = isolation.isolation_flags(spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1.0) for i in range(50)], schema))
    assert same.where("iso_flag = -1").count() == 0
    gap = isolation.isolation_flags(
        spark.createDataFrame([(i, float(i), 1.0, 1.0, None if i == 0 else 1.0) for i in range(50)], schema)
    )
    assert [(r.iso_score, r.iso_flag) for r in gap.where("id = 0").collect()] == [(None, None)]
    assert isolation.isolation_flag_count(gap).first().scored_rows == 49


def test_segments_recover_three_blobs_in_margin_order(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for label, (revenue, margin, discount), size in zip(
        segments.LABELS, [(1000, 15, 1), (500, 8, 5), (100, 2, 9)], [30, 50, 20]
    ):
        for _ in range(size):
            key = f"c{len(rows)}"
            rows.append((key, revenue + rng.normal(0, 20), margin + rng.normal(0, 0.3), discount + rng.normal(0, 0.3)))
            want[key] = label
    df = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, a, b, c in rows], "customer_id string, revenue double, margin double, discount double")
    got = segments.customer_segments(df)
    assert {r.customer_id: r.segment_label for r in got.collect()} == want
    table = segments.segment_margins(got).orderBy("place").collect()
    assert [(r.segment_label, r.customers) for r in table] == [("High Value", 30), ("Mid Tier", 50), ("Low Margin Risk", 20)]


def test_fewer_clusters_than_labels(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("b", 9.0, 9.0, 9.0)], "customer_id string, revenue double, margin double, discount double")
    got = {r.customer_id: r.segment_label for r in segments.customer_segments(df).collect()}
    assert got == {"b": "High Value", "a": "Mid Tier"}
    assert segments.customer_segments(df.where("customer_id = 'a'")).first().segment_label == "High Value"


def test_ten_starts_cost_no_more_than_ten_fits(spark, small):
    """All starts in shared passes: as cheap as the best of ten separate fits, and few scans of the customers."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    features = profitability.customer_features(star.sales(spark, small, "customer_id", "revenue", "margin_pct", "discount_pct"))
    scaled = segments.scaled_features(features).select(*segments.FEATURES).persist()
    points = np.array(scaled.collect())
    for k in (3, 5):
        starts = np.stack([segments.first_centres(points, k, seed) for seed in range(10)])
        with scans(spark) as seen:
            centres, sums, n = segments.best_clustering(scaled, starts, 300)
        cost = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
        assert n.sum() == len(points) and np.allclose(sums / n[:, None], centres, atol=1e-3)
        vectors = VectorAssembler(inputCols=list(segments.FEATURES), outputCol="features").transform(scaled)
        fits = [KMeans(k=k, seed=seed, maxIter=300).fit(vectors).summary.trainingCost for seed in range(10)]
        assert cost <= min(fits) * (1.0005 if k == 3 else 1.005)
        alone = [segments.best_clustering(scaled, starts[[i]], 300)[0] for i in range(3)]
        costs = [((points[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum() for c in alone]
        assert cost <= min(costs) * (1 + 1e-9)
    scaled.unpersist()
    with scans(spark) as seen:
        segments.customer_segments(features, max_iter=4).count()
    assert seen("table-") <= 4 + 3


def test_starts_cut_short_still_report_their_own_cost(spark):
    points = np.array([[0.0, 0, 0], [1, 0, 0], [10, 0, 0], [11, 0, 0]])
    frame = spark.createDataFrame([tuple(map(float, p)) for p in points], ", ".join(f"{c} double" for c in segments.FEATURES))
    starts = np.array([[[0.0, 0, 0], [1, 0, 0]], [[0, 0, 0], [10, 0, 0]]])
    centres, sums, n = segments.best_clustering(frame, starts, 1)
    assert centres[:, 0].tolist() == [0.5, 10.5] and n.tolist() == [2, 2] and sums[:, 0].tolist() == [1, 21]


def test_regressor_beats_the_mean(spark, small):
    table = regression.regression_table(
        catalog()["panel_features"](spark, small).where(F.col("product_id").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"))
    )
    got = regression.regressor_error(table, trees=10).first()
    test = table.where(~F.col("is_train"))
    mean = table.where("is_train").agg(F.avg("revenue")).first()[0]
    constant = test.withColumn("prediction", F.lit(mean)).agg(regression.mape()).first()[0]
    assert got.test_rows == test.count()
    assert 0 < got.regressor_mape < constant


def test_mape_and_winner(spark):
    df = spark.createDataFrame([(100.0, 90.0), (50.0, 60.0)], "revenue double, prediction double")
    row = df.agg(regression.mape().alias("m")).select(
        "m", regression.winner("m", True).alias("a"), regression.winner("m", False).alias("b"), regression.confidence("m").alias("c")
    ).first()
    assert tuple(row) == (15.0, "boosted_trees", "boosted_trees", 85.0)
    assert spark.createDataFrame([(20.0,)], "m double").select(regression.winner("m", True)).first()[0] == "seasonal"


def seasonal_series(months, start="2019-01-01", noise=0.0, seed=0):
    ds = pd.date_range(start, periods=months + 3, freq="MS")
    rng = np.random.default_rng(seed)
    season = 1 + 0.25 * np.sin(2 * np.pi * ds.month / 12) + 0.1 * np.cos(4 * np.pi * ds.month / 12)
    y = (1000 + 12 * np.arange(len(ds))) * season * np.exp(rng.normal(0, noise, len(ds)))
    return ds, y


def test_seasonal_forecast_recovers_trend_and_season(spark):
    rows = []
    truth = {}
    for key in ("a", "b"):
        ds, y = seasonal_series(60, start="2018-01-01" if key == "a" else "2019-04-01")
        rows += [(key, d.date(), float(v)) for d, v in zip(ds[:-3], y[:-3])]
        truth |= {(key, d.date()): v for d, v in zip(ds[-3:], y[-3:])}
    df = spark.createDataFrame(rows, "product_id string, date date, revenue double")
    got = forecast.seasonal_forecast(df, keys=["product_id"]).collect()
    assert len(got) == 6 and {r.model for r in got} == {"seasonal"}
    for r in got:
        assert r.yhat == pytest.approx(truth[r.product_id, r.ds], rel=0.05)
        assert r.yhat_lower <= r.yhat <= r.yhat_upper


def test_short_and_non_positive_series_are_fitted(spark):
    ds, y = seasonal_series(12)
    y = np.array(y)
    y[3], y[5] = 0.0, -40.0
    df = spark.createDataFrame([(d.date(), float(v)) for d, v in zip(ds[:-3], y[:-3])], "date date, revenue double")
    got = forecast.seasonal_forecast(df).orderBy("ds").collect()
    assert len(got) == 3 and {r.model for r in got} == {"seasonal"}
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in got)
    # lines are summed per day first, whatever the time of day
    halves = df.withColumn("revenue", F.col("revenue") / 2)
    later = halves.withColumn("date", F.col("date").cast("timestamp") + F.expr("interval 5 hours"))
    again = forecast.seasonal_forecast(halves.withColumn("date", F.col("date").cast("timestamp")).unionAll(later))
    assert again.orderBy("ds").collect() == got


def test_one_date_alone_grows(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 50.0)], "date date, revenue double")
    got = forecast.seasonal_forecast(df).orderBy("ds").collect()
    assert [tuple(r)[:4] for r in got] == [tuple(r) for r in forecast.growth_projection(df).orderBy("ds").collect()]
    assert {r.model for r in got} == {"growth"}


@pytest.mark.parametrize("months", [24, 36, 50, 80])
def test_the_band_holds_what_it_promises(months):
    """Share of the next three months inside the 80 % band, 150 simulated series."""
    inside = []
    for seed in range(150):
        rng = np.random.default_rng(seed)
        ds, y = seasonal_series(months)
        y = np.array(y) * (1 + rng.normal(0, 0.1, len(y)))
        centre, spread = forecast._fit(ds[:months], y[:months], ds[months:], {}, forecast._DEFAULTS)
        inside += list(np.abs(y[months:] - centre) <= spread)
    assert 0.75 <= np.mean(inside) <= 0.87


def test_customers_without_a_feature_are_set_aside(spark):
    rows = [(f"c{i}", float(i), float(i % 7), 1.0 + i % 3) for i in range(30)] + [("x", None, 1.0, 1.0), ("y", 1.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "customer_id string, revenue double, margin double, discount double")
    got = {r.customer_id: r.segment_label for r in segments.customer_segments(df).collect()}
    assert len(got) == 32 and got["x"] is None and got["y"] is None and sum(v is None for v in got.values()) == 2


def test_holidays_explain_their_months(spark):
    ds, y = seasonal_series(60, noise=0.01)
    special = ds[[5, 20, 33, 47]]
    y = np.where(ds.isin(special), y * 2, y)
    df = spark.createDataFrame([(d.date(), float(v)) for d, v in zip(ds[:-3], y[:-3])], "date date, revenue double")
    days = spark.createDataFrame([(d.date(), "fair") for d in special], "ds date, name string")
    plain = forecast.seasonal_forecast(df).orderBy("ds").collect()
    aware = forecast.seasonal_forecast(df, holidays=days).orderBy("ds").collect()
    assert [r.yhat for r in aware] == pytest.approx(list(y[-3:]), rel=0.05)
    assert all(a.yhat_upper - a.yhat_lower < p.yhat_upper - p.yhat_lower for a, p in zip(aware, plain))


# Published dates of Diwali and Holi (the day of colours), 2015 to 2030.
DIWALI = "11-11 10-30 10-19 11-07 10-27 11-14 11-04 10-24 11-12 10-31 10-20 11-08 10-29 10-17 11-05 10-26"
HOLI = "03-06 03-24 03-13 03-02 03-21 03-10 03-29 03-18 03-08 03-25 03-14 03-04 03-22 03-11 03-01 03-20"


def test_movable_holidays_fall_on_their_published_dates(spark):
    for day, published in ((calendar.diwali, DIWALI), (calendar.holi, HOLI)):
        assert [day(2015 + i).strftime("%m-%d") for i in range(16)] == published.split()
    table = calendar.indian_holidays(spark, 2019, 2020)
    assert {(r.ds.isoformat(), r.name) for r in table.where("name like '%li'").collect()} == {
        ("2019-10-27", "Diwali"), ("2020-11-14", "Diwali"), ("2019-03-21", "Holi"), ("2020-03-10", "Holi"),
    }
    assert table.count() == 10 and calendar.to_month_starts(table).where("dayofmonth(ds) > 1").count() == 0
    for year in range(1900, 2101):  # one of each, in every year
        assert 10 <= calendar.diwali(year).month <= 11 and 2 <= calendar.holi(year).month <= 4


def test_trend_bends_are_few_and_in_their_place():
    ds = pd.date_range("2015-01-01", periods=96, freq="MS")
    future = pd.date_range(ds[-1] + pd.DateOffset(months=1), periods=3, freq="MS")
    t = np.arange(96)
    rng = np.random.default_rng(4)
    straight = 100 + 2.0 * t
    bent = straight + np.where(t > 40, 6.0 * (t - 40), 0)
    for noise in (0.0, 1.0):
        *_, bends = forecast._fit_with_bends(ds, straight + noise * rng.normal(size=96), future, {}, forecast._DEFAULTS)
        assert sum(abs(b) for _, b in bends) < 0.1
        yhat, _, bends = forecast._fit_with_bends(ds, bent + noise * rng.normal(size=96), future, {}, forecast._DEFAULTS)
        when = sum(abs(b) * day.timestamp() for day, b in bends) / sum(abs(b) for _, b in bends)
        assert abs(pd.Timestamp(when, unit="s") - ds[40]) < pd.Timedelta(days=120)
        assert sum(abs(b) > 0.05 * max(abs(x) for _, x in bends) for _, b in bends) <= 6
        assert yhat == pytest.approx(100 + 2.0 * np.arange(96, 99) + 6.0 * (np.arange(96, 99) - 40), rel=0.03)


def test_trend_word(spark):
    up = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 3, 1), 2.0)], "ds date, yhat double")
    assert forecast.trend(up).first().trend == "upward"
    level = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 3, 1), 1.0)], "ds date, yhat double")
    assert forecast.trend(level).first().trend == "downward"


def test_forest_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def value(number: int) -> float:
        seen.add(1)
        return float(number * number % 97)

    rows = spark.range(300).select(F.col("id").alias("invoice_no"), F.udf(value, "double")("id").alias("taxable_value"))
    rows = rows.withColumn("cgst_amount", F.col("invoice_no") % 7)
    scored = isolation.isolation_scores(rows, ["taxable_value", "cgst_amount"], trees=5, partitions=4, rows=300).collect()
    assert len(scored) == 300 and all(r.iso_score is not None for r in scored)
    assert seen.value == 300


def test_forest_walk_finds_the_cell_of_every_row():
    rng = np.random.default_rng(3)
    height, width, n = 5, 3, isolation._ROWS_AT_ONCE + 7
    feature, cut = rng.integers(0, width, (4, 31)), rng.normal(size=(4, 31))
    cut[:, 9:12] = np.inf
    path, x = rng.random((4, 32)), rng.normal(size=(n, width))
    x[::5, 1], x[::7, 2] = np.nan, np.inf
    got = isolation._mean_depth(x, feature, cut, path, height)
    for row in (0, 5, 7, 35, 1000, n - 1):
        total = 0.0
        for tree in range(4):
            node = 0
            for _ in range(height):
                node = 2 * node + (2 if x[row, feature[tree][node]] > cut[tree][node] else 1)
            total += path[tree][node - 31]
        assert got[row] == total / 4
