"""Column expressions for words and lines, shared by the native operators."""

from __future__ import annotations

import os
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]`` in order; no words for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def removed_length(text: Column, pattern: str) -> Column:
    """Number of code points that ``pattern`` matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a folder. Python workers get the path of this package, wherever the driver was started."""
    paths = spark.sparkContext.environment
    if ROOT not in (known := paths.get("PYTHONPATH", "")).split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers each that may be sent to every executor.
SMALL_TABLE_ROWS = 1_000_000


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small; else Spark joins it by shuffling."""
    return F.broadcast(df) if df.limit(SMALL_TABLE_ROWS + 1).count() <= SMALL_TABLE_ROWS else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Inside the block, jobs hand at most ``rows`` rows at once to Python: texts can be long, and memory is shared."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
