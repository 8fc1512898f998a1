"""Top-k, global row positions and exact quantiles without a one-task sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage

_LOW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows in the given order, with their 1-based ``rank``.

    The limit runs first (TakeOrderedAndProject keeps k rows per task), so the
    window over one partition only ever sees k rows.
    """
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def with_position(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in the global order.

    A range-partitioned sort numbers rows inside each partition; the sizes of the
    preceding partitions are added as an offset. The running sum is over one row per
    partition, so no task ever holds the data. The numbered rows are written down because
    partition bounds are sampled and would differ if computed twice.
    """
    ordered = cut_lineage(df.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id()))
    part = F.shiftright("_seq", _LOW_BITS)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # At most one row per shuffle partition, so the broadcast is bounded by configuration.
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_seq").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)) + 1)
        .drop("_part", "_before", "_seq")
    )


def exact_quantile(df: DataFrame, col: str, q: float, bins: int = 65536) -> tuple[float | None, int]:
    """Exact q-quantile (linear interpolation, as numpy) of a double column, and the row count.

    Histogram refinement: each pass counts the candidate range in at most ``bins`` bins
    and keeps the bin that holds the wanted ranks. The lowest and highest candidate always
    land in different bins, so each pass narrows the range; two or three passes are usual.
    Only histograms reach the driver, and copies of one value cost nothing extra.
    Missing values are ignored.
    """
    values = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if n == 0:
        return None, 0
    spot = (n - 1) * q
    rank = math.floor(spot)
    next_rank = min(rank + 1, n - 1)
    below, above = 0, high
    while low < high:
        counts = _histogram(values, low, high, bins)
        at = 0
        while below + counts[at].n <= rank:
            below += counts[at].n
            at += 1
        low, high = counts[at].lo, counts[at].hi
        if at + 1 < len(counts):
            above = counts[at + 1].lo
        if next_rank >= below + counts[at].n:
            return high + (above - high) * (spot - rank), n
    return low, n


def _histogram(values: DataFrame, low: float, high: float, bins: int) -> list:
    width = (high - low) / bins
    bin_no = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return (
        values.where(F.col("v").between(low, high))
        .groupBy(bin_no.alias("b"))
        .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .orderBy("b")
        .collect()
    )
