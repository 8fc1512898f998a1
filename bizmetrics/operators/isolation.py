"""Isolation-forest flags (Liu, Ting, Zhou 2008) on Spark.

Trees are grown side by side from bounded random samples, one small group per tree; the
rows themselves are only ever scored in place, batch by batch, and never moved.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.functions.ordering import exact_quantile

# The functions run by Python workers travel with the plan, so workers need not have this package.
register_pickle_by_value(sys.modules[__name__])

FEATURES = ("taxable_value", "cgst_amount", "sgst_amount", "total_tax_amount")
KEYS = ("invoice_no", "counterparty_id", "return_period")
CONTAMINATION = 0.12

#: Rows that are walked through a tree together: their arrays stay in the processor's cache.
_ROWS_AT_ONCE = 1 << 14

_TREE_SCHEMA = "tree int, feature array<int>, cut array<double>, path array<double>"


def isolation_scores(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    trees: int = 100,
    sample_size: int = 256,
    seed: int = 42,
    keys: Sequence[str] | None = None,
    partitions: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add ``iso_score``: near 1 for rows that few random cuts isolate. Missing where a feature is.

    ``keys`` are the columns that tell rows apart (default: those of ``KEYS`` that ``df`` has); with the features and the
    seed they alone decide which rows the trees see. The rows are written down first. ``partitions`` spreads them
    before they are scored if they were written by fewer tasks: files that cannot be split. ``rows`` is the number of rows without a missing feature, where it is known.
    """
    keys = [c for c in KEYS if c in df.columns] if keys is None else list(keys)
    df = cut_lineage(df)  # read for the count, for the samples and to be scored: computed once
    complete = _complete(df, keys, features)
    n = complete.count() if rows is None else rows
    if n == 0:
        return df.withColumn("iso_score", F.lit(None).cast("double"))
    psi = min(sample_size, n)
    height = math.ceil(math.log2(psi)) if psi > 1 else 0
    grown = (
        _tree_samples(complete, keys, features, n, trees, psi, seed)
        .groupBy("tree")
        .applyInPandas(_grower(list(features), height, seed), _TREE_SCHEMA)
        .orderBy("tree")
        .collect()  # one row per tree, 2**height cells each
    )
    forest = df.sparkSession.sparkContext.broadcast(
        (
            np.array([t.feature for t in grown], dtype=np.int64),
            np.array([t.cut for t in grown], dtype=float),
            np.array([t.path for t in grown], dtype=float),
        )
    )
    scale = _mean_path(psi)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, cut, path = forest.value
        for columns in parts:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            depth = _mean_depth(x, feature, cut, path, height)
            value = np.power(2.0, -depth / scale) if scale > 0 else np.ones(len(x))
            value[np.isnan(x).any(axis=1)] = np.nan
            yield pd.Series(value)

    scored = score(*[F.col(c).cast("double") for c in features])
    if partitions is not None and len(df.inputFiles()) < partitions:
        df = df.repartition(partitions)
    return df.withColumn("iso_score", scored).withColumn(
        "iso_score", F.nanvl("iso_score", F.lit(None).cast("double"))
    )


def isolation_flags(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    contamination: float = CONTAMINATION,
    trees: int = 100,
    sample_size: int = 256,
    seed: int = 42,
    keys: Sequence[str] | None = None,
    partitions: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add ``iso_score`` and ``iso_flag``: -1 for the most isolated share of rows, else 1.

    A row is flagged when its negated score is strictly below the interpolated quantile of
    all negated scores, so rows tied at the quantile are not. Scoring is the costly step, so
    the scored rows are written down once: pass only the columns that are wanted.
    """
    scored = cut_lineage(isolation_scores(df, features, trees, sample_size, seed, keys, partitions, rows))
    threshold, _ = exact_quantile(scored.select((-F.col("iso_score")).alias("s")), "s", contamination)
    flag = F.when(-F.col("iso_score") < F.lit(threshold), -1).when(F.col("iso_score").isNotNull(), 1)
    return scored.withColumn("iso_flag", flag)


def tasks_for(df: DataFrame) -> int | None:
    """As many tasks as there are cores when ``df`` comes from fewer files: a small file is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores if len(df.inputFiles()) < cores else None


def isolation_flag_count(flags: DataFrame) -> DataFrame:
    return flags.agg(
        F.count("iso_flag").alias("scored_rows"), F.count(F.when(F.col("iso_flag") == -1, 1)).alias("flagged")
    )


def _complete(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    key = F.xxhash64(*[F.col(c) for c in keys]) if keys else F.lit(0).cast("bigint")
    return df.select(key.alias("_key"), *[F.col(c).cast("double").alias(c) for c in features]).na.drop(subset=list(features))


def _tree_samples(
    complete: DataFrame, keys: Sequence[str], features: Sequence[str], n: int, trees: int, psi: int, seed: int
) -> DataFrame:
    """trees x psi rows with their tree number.

    One rule at every size: the hash of a row's keys, features and the seed decides whether it is in the pool of about
    4 x slots rows, whatever the partitioning. The pool, a few times trees x psi, is put in an order by hash and dealt out in turn; a small table is
    dealt out several times, in a new order each time.
    """
    slots = trees * psi
    share = F.lit(min(1.0, 4 * slots / n))
    drawn = F.pmod(F.xxhash64("_key", *features, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counted = F.count(F.lit(1)).alias("copies")
    if keys:
        # Keys tell rows apart, so only the pool is grouped; more copies of one row than slots are never dealt.
        pool = complete.where(drawn < share).groupBy("_key", *features).agg(counted)
        pool = pool.withColumn("copies", F.least("copies", F.lit(slots).cast("bigint")))
    else:
        # Rows are their features: of c copies floor(c * share + u) are drawn, u the row's own fraction.
        pool = complete.groupBy("_key", *features).agg(counted)
        pool = pool.withColumn("copies", F.floor(F.col("copies") * share + (1 - drawn) * 0.999999999)).where("copies > 0")
    pool = pool.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    rounds = math.ceil(slots / n)
    dealt = pool.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn(
        "key", F.xxhash64("_key", *features, "copy", "round", F.lit(seed))
    )
    order = [F.col(c) for c in ("round", "key", *features, "copy")]
    first = dealt.orderBy(*order).limit(slots)  # keeps trees x psi rows per task
    slot = F.row_number().over(Window.orderBy(*order)) - 1
    return first.withColumn("slot", slot).select((F.col("slot") % trees).alias("tree"), *features)


def _grower(features: list[str], height: int, seed: int):
    """Function that grows one tree as a full binary heap; early leaves fill all cells below them."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[features].sort_values(features).to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        inner = 2**height - 1
        feature = np.zeros(inner, dtype=int)
        cut = np.full(inner, np.inf)
        path = np.zeros(inner + 1)
        todo = [(0, 0, x)]
        while todo:
            node, depth, rows = todo.pop()
            low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
            splittable = np.flatnonzero(low < high)
            if depth == height or len(splittable) == 0:
                span = 2 ** (height - depth)
                first = (node + 1) * span - 1 - inner
                path[first : first + span] = depth + _mean_path(len(rows))
                continue
            by = rng.choice(splittable)
            at = rng.uniform(low[by], high[by])
            if at >= high[by]:
                at = low[by]
            feature[node], cut[node] = by, at
            left = rows[:, by] <= at
            todo.append((2 * node + 2, depth + 1, rows[~left]))
            todo.append((2 * node + 1, depth + 1, rows[left]))
        return pd.DataFrame(
            {"tree": [tree], "feature": [feature.tolist()], "cut": [cut.tolist()], "path": [path.tolist()]}
        )

    return grow


def _mean_depth(x: np.ndarray, feature, cut, path, height: int) -> np.ndarray:
    """Mean path over the trees, some thousand rows at a time, in arrays that every step writes again."""
    inner = 2**height
    # Node 1 is the root, so the children of node i are 2i and 2i + 1.
    features, cuts = np.zeros((len(path), inner), np.intp), np.full((len(path), inner), np.inf)
    features[:, 1:], cuts[:, 1:] = feature, cut
    total = np.zeros(len(x))
    for at in range(0, len(x), _ROWS_AT_ONCE):
        rows = np.ascontiguousarray(x[at : at + _ROWS_AT_ONCE], dtype=float)
        n, values = len(rows), rows.ravel()
        first = np.arange(n, dtype=np.intp) * rows.shape[1]
        node, place = np.empty(n, np.intp), np.empty(n, np.intp)
        value, bound, right = np.empty(n), np.empty(n), np.empty(n, bool)
        for tree in range(len(path)):
            node.fill(1)
            for _ in range(height):
                # Every place is in range; "clip" only spares a check and a copy.
                features[tree].take(node, out=place, mode="clip")
                np.add(place, first, out=place)
                values.take(place, out=value, mode="clip")
                cuts[tree].take(node, out=bound, mode="clip")
                np.greater(value, bound, out=right)
                np.add(node, node, out=node)
                np.add(node, right, out=node)
            np.subtract(node, inner, out=node)
            path[tree].take(node, out=value, mode="clip")
            total[at : at + n] += value
    return total / len(path)


def _mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n keys."""
    if n < 2:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
