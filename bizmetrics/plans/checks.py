"""What must hold of the models' results, as small tables that plain SQL over the inputs can confirm."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.functions.ordering import exact_quantile
from bizmetrics.operators import regression, segments


def outlier_checks(flags: DataFrame, contamination: float) -> DataFrame:
    """Rows scored; whether scores are in range, flags go to the most isolated rows, and to no more than their share."""
    flagged, n = F.count(F.when(F.col("iso_flag") == -1, 1)), F.count("iso_score")
    lowest = F.min(F.when(F.col("iso_flag") == -1, F.col("iso_score")))
    highest = F.max(F.when(F.col("iso_flag") == 1, F.col("iso_score")))
    return flags.agg(
        n.alias("scored_rows"),
        ((F.min("iso_score") > 0) & (F.max("iso_score") <= 1)).alias("scores_in_range"),
        F.coalesce(lowest > highest, F.lit(True)).alias("flagged_are_most_isolated"),
        (flagged <= F.lit(contamination) * (n - 1) + 1).alias("flagged_within_share"),
    )


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """Exact quantiles of a column, to six decimals."""
    found = [(q, exact_quantile(df, column, q)[0]) for q in shares]
    return df.sparkSession.createDataFrame(found, "share double, value double").withColumn("value", F.round("value", 6))


def segment_checks(placed: DataFrame) -> DataFrame:
    """Customers placed, segments used; whether labels follow the mean margin and nobody is nearer to another segment's mean."""
    placed = cut_lineage(segments.scaled_features(placed.where("segment_label is not null")))
    means = placed.groupBy("segment_label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in segments.FEATURES])
    means = means.agg(F.map_from_entries(F.collect_list(F.struct("segment_label", F.struct(*[f"m_{c}" for c in segments.FEATURES])))))
    at = placed.withColumn("means", means.scalar())

    def distance(to: Column) -> Column:
        return reduce(add, [(F.col(c) - to[f"m_{c}"]) * (F.col(c) - to[f"m_{c}"]) for c in segments.FEATURES])

    own = distance(F.col("means")[F.col("segment_label")])
    nearest = F.array_min(F.transform(F.map_values("means"), distance))
    margins = [F.first("means")[label]["m_margin"] for label in segments.LABELS]
    return at.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_distinct("segment_label").alias("segments"),
        ((margins[0] > margins[1]) & (margins[1] > margins[2])).alias("labels_by_margin"),
        # A centre may stop within the tolerance of its rows' mean.
        F.coalesce(F.max(F.sqrt(own) - F.sqrt(nearest)) < 10 * segments.TOLERANCE, F.lit(True)).alias("settled"),
    )


def regressor_checks(table: DataFrame, **options) -> DataFrame:
    """Rows of the test part; whether the error beats that of the training mean, and the confidence is the rest of 100."""
    table = cut_lineage(table)
    error = regression.regressor_error(table, **options)
    mean = table.where("is_train").agg(F.avg("revenue")).scalar()
    plain = table.where(~F.col("is_train")).withColumn("prediction", mean).agg(regression.mape()).scalar()
    return error.select(
        "test_rows",
        ((F.col("regressor_mape") > 0) & (F.col("regressor_mape") < plain)).alias("beats_the_mean"),
        (F.col("confidence") == 100 - F.col("regressor_mape")).alias("confidence_is_the_rest"),
    )


def seasonal_checks(ahead: DataFrame) -> DataFrame:
    """Months forecast, by which model, and whether each lies inside its band."""
    inside = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return ahead.select("ds", "model", inside.alias("in_band"))
