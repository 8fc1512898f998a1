"""Boosted-tree revenue regressor on the panel features, and its error on the held-out part."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizmetrics.functions.numeric import round_np
from bizmetrics.operators.sales import panel_split, product_codes, region_codes

# The regressor's features.
FEATURES = (
    "lag_1", "lag_3", "lag_12", "rolling_3", "rolling_std3", "month", "quarter", "year", "is_festive",
    "avg_discount", "returns", "region_enc", "product_enc",
)

#: Rows of the training part that one task fits.
TASK_ROWS = 50_000

_EPSILON = 2.220446049250313e-16


def regression_table(features: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Panel features with codes, row position and the train/test mark.

    Both codes come from one table with a row per product and region, so the panel is joined once and never dealt
    by the few regions alone. No hint: that table grows with the catalogue.
    """
    split = panel_split(features, train_share)
    pairs = split.select("product_id", "region").distinct()
    codes = pairs.join(product_codes(split), "product_id").join(region_codes(split), "region")
    return split.join(codes, ["product_id", "region"])


def fit_regressor(
    train: DataFrame,
    trees: int = 300,
    learning_rate: float = 0.05,
    depth: int = 5,
    row_share: float = 0.8,
    column_share: float = 0.8,
    seed: int = 42,
) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    booster = GBTRegressor(
        labelCol="revenue",
        maxIter=trees,
        stepSize=learning_rate,
        maxDepth=depth,
        subsamplingRate=row_share,
        featureSubsetStrategy=str(column_share),
        seed=seed,
    )
    if "position" in train.columns:
        # The booster draws rows partition by partition: the same rows in the same places give the same trees.
        last = train.agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
        place = ((F.col("position") - 1) / TASK_ROWS).cast("int")
        train = train.repartitionById(1 + int(last) // TASK_ROWS, place).sortWithinPartitions("position")
    # The booster reads its input several times before it keeps a copy of its own.
    vectors = assembler.transform(train).select("features", "revenue").persist()
    try:
        return PipelineModel(stages=[assembler, booster.fit(vectors)])
    finally:
        vectors.unpersist()


def predict(model: PipelineModel, table: DataFrame) -> DataFrame:
    """Add ``prediction`` to rows that have the regression features."""
    return model.transform(table).drop("features")


def mape(actual="revenue", predicted="prediction") -> Column:
    """Mean absolute percentage error in percent, two decimals."""
    y, p = F.col(actual), F.col(predicted)
    error = F.abs(y - p) / F.greatest(F.abs(y), F.lit(_EPSILON))
    return round_np(F.avg(error) * F.lit(100.0), 2)


def regressor_error(table: DataFrame, **options) -> DataFrame:
    """Fit on the training part; one row with the error and size of the test part."""
    model = fit_regressor(table.where("is_train"), **options)
    error = predict(model, table.where(~F.col("is_train"))).agg(
        mape().alias("regressor_mape"), F.count(F.lit(1)).alias("test_rows")
    )
    return error.withColumn("confidence", confidence())


def winner(regressor_mape, has_seasonal: bool, limit: float = 20.0) -> Column:
    """Which of the two models is named as the better one."""
    if not has_seasonal:
        return F.lit("boosted_trees")
    return F.when(F.col(regressor_mape) < limit, "boosted_trees").otherwise("seasonal")


def confidence(regressor_mape="regressor_mape") -> Column:
    return F.lit(100.0) - F.col(regressor_mape)
