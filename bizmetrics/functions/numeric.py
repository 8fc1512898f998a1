"""Rounding, means and totals with pandas/numpy semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_np(col, digits: int = 0) -> Column:
    """Round half to even on the scaled double, as numpy does (12.45 -> 12.4)."""
    value = _col(col).cast("double")
    if digits == 0:
        return F.rint(value)
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def round_float(col, digits: int = 0) -> Column:
    """Round the exact binary value, as Python does for plain floats (12.35 -> 12.3, 12.25 -> 12.2).

    The product with 10**digits may land on a tie the exact value is not on; its rounding
    error, from an error-free product of the two halves of the number, tells on which side.
    """
    value = _col(col).cast("double")
    scale = F.lit(float(10**digits))
    scaled = value * scale
    shifted = value * F.lit(134217729.0)  # 2**27 + 1 splits a double into two halves
    high = shifted - (shifted - value)
    error = (high * scale - scaled) + (value - high) * scale
    below = F.floor(scaled)
    tie = (scaled - below) == F.lit(0.5)
    return (
        F.when(tie & (error > 0), below + 1).when(tie & (error < 0), below).otherwise(F.rint(scaled)) / scale
    )


def sum0(col) -> Column:
    """Sum that is 0, not NULL, when there is nothing to add."""
    return F.coalesce(F.sum(_col(col)), F.lit(0))


def mean(col) -> Column:
    """Mean of the non-missing values: exact sum first, one double division last."""
    return ratio(F.sum(_col(col)), F.count(_col(col)))


def ratio(total, count) -> Column:
    """total / count as a double; NULL when count is 0."""
    return F.try_divide(_col(total).cast("double"), _col(count).cast("double"))


def percent(part, whole, digits: int = 1) -> Column:
    """part of whole in percent; NULL for an empty table."""
    return round_float(ratio(part, whole) * F.lit(100.0), digits)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_where(condition: Column, col) -> Column:
    return sum0(F.when(condition, _col(col)))


def whole(col) -> Column:
    """Cut the fraction off, towards zero."""
    return _col(col).cast("bigint")


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that have all keys: pandas drops a group whose key is missing, Spark keeps it."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def _col(col) -> Column:
    return F.col(col) if isinstance(col, str) else col
