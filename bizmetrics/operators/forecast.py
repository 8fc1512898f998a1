"""Three-month revenue forecasts: growth projection in SQL, seasonal model per series."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizmetrics.functions.numeric import keyed, round_np, sum0
from bizmetrics.operators.sales import last_dates

# The functions run by Python workers travel with the plan, so workers need not have this package.
register_pickle_by_value(sys.modules[__name__])

# Monthly growth of the projection and its band around the base.
GROWTH = 1.02
BAND = (0.9, 1.1)


def _first_month_start(last_date) -> Column:
    """First month start on or after one month past the last date."""
    later = F.add_months(last_date, 1)
    return F.when(F.dayofmonth(later) == 1, later).otherwise(F.add_months(F.trunc(later, "month"), 1))


def growth_projection(series: DataFrame, periods: int = 3, growth: float = GROWTH, band=BAND) -> DataFrame:
    """Mean of the last six dates grown by a fixed rate per month, within a fixed band."""
    base = F.col("recent_mean")
    return (
        last_dates(series)
        .where(F.col("last_date").isNotNull())
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
        .select(
            F.add_months(_first_month_start("last_date"), F.col("step") - 1).alias("ds"),
            round_np(base * F.pow(F.lit(growth), F.col("step").cast("double"))).alias("yhat"),
            round_np(base * F.lit(band[0])).alias("yhat_lower"),
            round_np(base * F.lit(band[1])).alias("yhat_upper"),
        )
    )


def trend(forecast: DataFrame) -> DataFrame:
    """One row: upward when the last forecast is above the first, else downward."""
    rises = F.max_by("yhat", "ds") > F.min_by("yhat", "ds")
    return forecast.agg(F.when(rises, "upward").otherwise("downward").alias("trend"))


def seasonal_forecast(
    series: DataFrame,
    keys: Sequence[str] = (),
    periods: int = 3,
    holidays: DataFrame | None = None,
    **options: float,
) -> DataFrame:
    """Trend x (1 + yearly season) fitted on each whole series, with an 80 % band.

    ``series`` has the keys, ``date`` and ``revenue``. It is summed per key and day first, so
    a group handed to Python is one calendar's worth of numbers however many rows it came
    from. Series spread over the cluster by key. Zero and negative months take part. Only a
    series of one date has nothing to fit and gets the growth projection; the ``model`` column
    says so. ``holidays`` (ds, name) is a calendar table, joined by date; the month starts
    that are forecast are looked up in it too.
    """
    names = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    settings = {**_DEFAULTS, **options}

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _project(pdf, periods, settings)
        for position, name in enumerate(names):
            out.insert(position, name, pdf[name].iloc[0])
        return out

    schema = ", ".join(
        [f"{name} {kinds[name]}" for name in names]
        + ["ds date", "yhat double", "yhat_lower double", "yhat_upper double", "model string"]
    )
    rows = (
        keyed(series.withColumn("date", F.to_date("date")), *names, "date")
        .groupBy(*names, "date")
        .agg(sum0("revenue").cast("double").alias("revenue"))
    )
    if holidays is None:
        rows = rows.withColumn("holidays", F.array().cast("array<string>"))
    else:
        # The month starts to come, without revenue, so that holidays on them are joined as well.
        last = rows.groupBy(*names).agg(F.max("date").alias("last"))
        step = F.explode(F.sequence(F.lit(0), F.lit(periods - 1)))
        ahead = last.select(*names, _first_month_start("last").alias("from"), step.alias("step"))
        ahead = ahead.select(*names, F.add_months("from", F.col("step")).alias("date"), F.lit(None).cast("double").alias("revenue"))
        per_day = holidays.select(F.to_date("ds").alias("date"), "name").groupBy("date").agg(F.collect_set("name").alias("holidays"))
        rows = rows.unionByName(ahead).join(per_day, "date", "left")
    return rows.groupBy(*names).applyInPandas(project, schema)


_DEFAULTS = {
    "fourier_order": 5,
    "changepoints": 25,
    "changepoint_range": 0.8,
    "changepoint_prior": 0.05,
    "season_prior": 10.0,
    "z": 1.2816,  # two-sided 80 % of a normal distribution
}


def _month_starts(last: pd.Timestamp, periods: int) -> pd.DatetimeIndex:
    return pd.date_range(last + pd.DateOffset(months=1), periods=periods, freq="MS")


def _project(pdf: pd.DataFrame, periods: int, settings: dict) -> pd.DataFrame:
    pdf = pdf.assign(date=pd.to_datetime(pdf["date"])).sort_values("date")
    past = pdf[pdf["revenue"].notna()]
    ds, y = pd.DatetimeIndex(past["date"]), past["revenue"].to_numpy(dtype=float)
    future = _month_starts(ds[-1], periods)
    days: dict[str, set] = {}
    for date, names in zip(pdf["date"], pdf["holidays"]):
        for name in sorted(names) if names is not None else ():
            days.setdefault(name, set()).add(date)
    if len(y) < 2:
        yhat = y[-1] * GROWTH ** np.arange(1, periods + 1)
        low, high = np.full(periods, y[-1] * BAND[0]), np.full(periods, y[-1] * BAND[1])
        model = "growth"
    else:
        yhat, spread = _fit(ds, y, future, days, settings)
        low, high = yhat - spread, yhat + spread
        model = "seasonal"
    return pd.DataFrame(
        {
            "ds": future.date,
            "yhat": np.rint(yhat),
            "yhat_lower": np.rint(low),
            "yhat_upper": np.rint(high),
            "model": model,
        }
    )


def _fit(ds, y, future, holidays, settings) -> tuple[np.ndarray, np.ndarray]:
    """Forecast and half width of its band: penalised least squares of trend x (1 + season)."""
    yhat, spread, _ = _fit_with_bends(ds, y, future, holidays, settings)
    return yhat, spread


def _fit_with_bends(ds, y, future, holidays, settings) -> tuple[np.ndarray, np.ndarray, list[tuple[pd.Timestamp, float]]]:
    """As ``_fit``, with the bends of the trend: when, and by how much the slope changes (of the largest value, per whole span).

    Trend and season are fitted in turn, each linear while the other stands still, and the
    noise is taken from the residuals of the fit before. Bends have a Laplace prior, so most of them are exactly 0.
    The band adds three parts: noise in proportion to the level (residuals over n less the fit's own degrees of freedom), the
    uncertainty of the weights that are not 0, and bends of the trend that may still come.
    """
    scale = max(np.abs(y).max(), 1e-12)
    level = y / scale
    start, span = ds[0], max((ds[-1] - ds[0]).days, 1)
    n_bends = max(0, int(min(settings["changepoints"], len(y) * settings["changepoint_range"] - 1)))
    bends = np.linspace(0, settings["changepoint_range"], n_bends + 1)[1:]
    harmonics = np.arange(1, int(settings["fourier_order"]) + 1)

    def design(when: pd.DatetimeIndex) -> tuple[np.ndarray, np.ndarray]:
        t = (when - start).days.to_numpy() / span
        turn = 2 * np.pi * (when - pd.Timestamp("1970-01-01")).days.to_numpy() / 365.25
        trend = np.column_stack([np.ones_like(t), t, np.maximum(t[:, None] - bends, 0)])
        waves = [np.sin(turn[:, None] * harmonics), np.cos(turn[:, None] * harmonics)]
        return trend, np.column_stack(waves + [when.isin(list(days)).astype(float) for days in holidays.values()])

    trend, season = design(ds)
    # Seasons are shares of the trend; a prior far above 1 would let them cancel it.
    season_prior = np.full(season.shape[1], min(settings["season_prior"], 1.0))

    def ridge(x: np.ndarray, target: np.ndarray, prior: np.ndarray, noise: float) -> np.ndarray:
        return np.linalg.solve(x.T @ x + np.diag((noise / prior) ** 2), x.T @ target)

    noise = max(np.std(level) / 2, 1e-6)
    shares = np.zeros(season.shape[1])
    weights = np.zeros(2 + n_bends)
    for _ in range(20):
        weights = sparse_trend(trend * (1 + season @ shares)[:, None], level, weights, noise, settings["changepoint_prior"])
        base = trend @ weights
        shares = ridge(season * base[:, None], level - base, season_prior, noise)
        used = np.append([True, True], weights[2:] != 0)
        priors = np.concatenate([np.full(used.sum(), LINE_PRIOR), season_prior])
        joint = np.column_stack([trend[:, used] * (1 + season @ shares)[:, None], season * base[:, None]])
        inverse = np.linalg.inv(joint.T @ joint + np.diag((noise / priors) ** 2))
        freedom = np.trace(joint @ inverse @ joint.T)
        residual = level - base * (1 + season @ shares)
        before, noise = noise, max(np.sqrt((residual**2).sum() / max(len(y) - freedom, 1.0)), 1e-6)
        if abs(noise - before) < 1e-3 * before:
            break
    trend_ahead, season_ahead = design(future)
    base, factor = trend_ahead @ weights, 1 + season_ahead @ shares
    joint = np.column_stack([trend_ahead[:, used] * factor[:, None], season_ahead * base[:, None]])
    ahead = (future - ds[-1]).days.to_numpy() / span
    bend = np.mean(np.abs(weights[2:])) if n_bends else 0.0
    rate = n_bends / settings["changepoint_range"]
    coming = rate * ahead * (2 * bend**2) * ahead**2 / 3 * factor**2
    # Quantile of Student's t in place of the normal one: the noise itself is an estimate.
    spare = max(len(y) - freedom, 1.0)
    z = settings["z"] * (1 + (settings["z"] ** 2 + 1) / (4 * spare))
    # Noise in proportion to the level, which a month near zero does not fall under a quarter of.
    floor = max(np.mean(np.abs(level - residual)) / 4, 1e-12)
    relative = residual / np.maximum(np.abs(level - residual), floor)
    share = np.sqrt((relative**2).sum() / spare)
    own = (share * np.maximum(np.abs(base * factor), floor)) ** 2
    variance = own + noise**2 * np.einsum("ij,jk,ik->i", joint, inverse, joint) + coming
    when = [start + pd.Timedelta(days=float(b) * span) for b in bends]
    found = [(day, float(w)) for day, w in zip(when, weights[2:]) if w != 0]
    return scale * base * factor, scale * z * np.sqrt(variance), found


#: Standard deviation of the prior of the trend's level and first slope.
LINE_PRIOR = 5.0
#: Noise of the largest value that the bends' prior assumes at least.
LEAST_NOISE = 2e-3


def sparse_trend(x: np.ndarray, target: np.ndarray, weights: np.ndarray, noise: float, bend_prior: float) -> np.ndarray:
    """Weights of the trend's columns: a wide normal prior on the first two, a Laplace prior of that scale on the bends.

    Coordinate descent from ``weights``: each weight in turn takes its best value while the others stand still; a bend whose pull
    is below the prior's is 0.
    """
    noise = max(noise, LEAST_NOISE)
    gram, pull = x.T @ x, x.T @ target
    own = np.diag(gram).tolist()
    ridge = [(noise / LINE_PRIOR) ** 2] * 2 + [0.0] * (len(pull) - 2)
    threshold = [0.0] * 2 + [noise**2 / bend_prior] * (len(pull) - 2)
    places = [j for j in range(len(pull)) if own[j] > 0]
    weights = weights.copy()
    left = pull - gram @ weights  # what the weights leave to explain, kept up to date
    for _ in range(200):
        largest = 0.0
        for j in places:
            before = float(weights[j])
            rest = float(left[j]) + own[j] * before
            size = max(abs(rest) - threshold[j], 0.0) / (own[j] + ridge[j])
            change = (size if rest > 0 else -size) - before
            if change:
                left -= gram[j] * change
                weights[j] = before + change
                largest = max(largest, abs(change) * own[j] ** 0.5)
        if largest < 0.02 * noise:
            break
    return weights
