"""Exact distinct counts that add up.

A count of different ids by month says nothing about the count by year: an id may occur in several months. A set of ids can be added
up, and it is small as a bitmap. Ids get dense numbers from a dictionary; a rollup keeps, for each key and each bucket of 32,768
numbers, one bitmap per count. Bitmaps of finer keys or-ed together are the bitmap of the coarser key, so one rollup answers every grain.

Number 0 is the missing id, which counts as one value. Dictionaries grow: numbers once given stay.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.functions.ordering import with_position


def id_dictionary(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(id, number): numbers 1, 2, ... in the order of the ids; after those of ``known``, which keep theirs."""
    ids = df.select(F.col(column).alias("id")).where("id is not null").distinct()
    if known is None:
        return with_position(ids, "id", name="number")
    last = known.agg(F.coalesce(F.max("number"), F.lit(0))).scalar()
    new = with_position(ids.join(known, "id", "left_anti"), "id", name="number")
    return known.unionByName(new.select("id", (F.col("number") + last).alias("number")))


def distinct_rollup(
    df: DataFrame, keys: list[str], column: str, counts: Mapping[str, Column], dictionary: DataFrame | None = None
) -> DataFrame:
    """Rows of keys and ``bucket`` with a bitmap per name: the ids of ``column`` on rows where the name's condition holds.

    Lines are combined per key and id before they meet the dictionary, so a hot key or id is one row per task there.
    """
    flags = {name: F.max(F.coalesce(holds, F.lit(False))).alias(name) for name, holds in counts.items()}
    found = df.groupBy(*keys, F.col(column).alias("id")).agg(*flags.values())
    if dictionary is None:
        found = cut_lineage(found)
        dictionary = id_dictionary(found, "id")
    numbered = found.join(dictionary, "id", "left").withColumn("number", F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.col("number")))
    bits = [F.bitmap_construct_agg(F.when(F.col(n), F.bitmap_bit_position("number"))).alias(n) for n in counts]
    return numbered.groupBy(*keys, F.bitmap_bucket_number("number").alias("bucket")).agg(*bits)


def merge_distinct(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two rollups made with one (growing) dictionary as one."""
    names = [c for c in first.columns if c not in (*keys, "bucket")]
    return first.unionByName(second).groupBy(*keys, "bucket").agg(*[F.bitmap_or_agg(n).alias(n) for n in names])


def distinct_counts(rollup: DataFrame, names: list[str], *by: str | Column) -> DataFrame:
    """Number of different ids per name, by columns of the rollup or expressions over them (none: in all)."""
    by = tuple(F.col(b) if isinstance(b, str) else b for b in by)
    sets = rollup.groupBy(*by, "bucket").agg(*[F.bitmap_or_agg(n).alias(n) for n in names])
    labels = sets.columns[: len(by)]
    totals = [F.coalesce(F.sum(F.bitmap_count(n)), F.lit(0)).cast("bigint").alias(n) for n in names]
    return sets.groupBy(*[F.col(f"`{label}`") for label in labels]).agg(*totals)
