"""Customer segments: scaled k-means, labelled by mean margin.

All starts run together. One pass over the customers serves one round of every start that still moves: each task keeps, per start
and cluster, the number, the sum and the cost of the rows nearest to it, and only these sums leave it. Mean and deviation are
observed while the customers are written, and the first centres come from one more pass.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage

# The function run by Python workers travels with the plan, so workers need not have this package.
register_pickle_by_value(sys.modules[__name__])

# Segment names from the highest mean margin to the lowest.
LABELS = ("High Value", "Mid Tier", "Low Margin Risk")
FEATURES = ("revenue", "margin", "discount")
#: First centres are drawn from about so many rows, chosen by a hash of the row, whatever the table.
SEEDING_ROWS = 4096
#: A start is done when no centre moves further than this, in standard deviations.
TOLERANCE = 1e-4
_CHUNK = 8192


def customer_segments(
    features: DataFrame,
    labels: Sequence[str] = LABELS,
    seeds: Sequence[int] = tuple(range(42, 52)),
    max_iter: int = 300,
) -> DataFrame:
    """Add ``segment`` and ``segment_label`` to the customer features.

    The cheapest of one k-means per seed is kept. Labels go to the clusters by falling mean margin;
    with fewer clusters than labels the last labels stay unused. A customer with a missing
    feature cannot be placed: its segment and label are missing, and no start sees it.
    """
    missing = reduce(or_, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in FEATURES])
    seen = Observation()
    numbers = {c: F.when(~missing, F.col(c).cast("double")) for c in FEATURES}
    moments = [f(numbers[c]).alias(f"{name}_{c}") for c in FEATURES for name, f in (("mean", F.avg), ("deviation", F.stddev_samp))]
    everyone = cut_lineage(features.observe(seen, F.count(F.when(~missing, 1)).alias("rows"), *moments))  # read by every round and by the result
    found = seen.get
    mean, deviation = (np.array([found[f"{name}_{c}"] or 0.0 for c in FEATURES], float) for name in ("mean", "deviation"))
    deviation = np.nan_to_num(deviation)
    features = everyone.where(~missing)
    rows = _sample(features, found["rows"])
    k = len(labels)
    if len(np.unique(rows, axis=0)) < k:
        # Few different rows in the sample: then the table decides. Fewer different customers make fewer clusters.
        k = features.select(*FEATURES).distinct().limit(k).count()
    if k < 2:
        only = F.when(~missing, F.lit(0))
        return everyone.withColumn("segment", only).withColumn("segment_label", F.when(only == 0, F.lit(labels[0])))
    scale = np.where(deviation > 0, deviation, np.inf)
    points = features.select(*[x.alias(c) for c, x in zip(FEATURES, _scaled(mean, scale))])
    starts = np.stack([first_centres((rows - mean) / scale, k, seed) for seed in seeds])
    centres, sums, n = best_clustering(points, starts, max_iter)
    margins = sums[:, FEATURES.index("margin")] / np.maximum(n, 1)
    ranked = sorted(range(k), key=lambda c: (n[c] == 0, -margins[c], c))
    label = F.create_map(*[F.lit(cell) for cluster, name in zip(ranked, labels) for cell in (cluster, name)])
    placed = everyone.withColumn("segment", F.when(~missing, _nearest(centres, mean, scale)))
    return placed.withColumn("segment_label", label[F.col("segment")])


def scaled_features(features: DataFrame) -> DataFrame:
    """The features in standard deviations from their mean; a constant feature is 0, a missing one stays missing."""
    moments = [f(F.col(c).cast("double")).alias(f"{name}_{c}") for c in FEATURES for name, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    m = features.agg(*moments).first()
    mean = np.array([m[f"mean_{c}"] or 0.0 for c in FEATURES], float)
    scale = np.array([m[f"sd_{c}"] or np.inf for c in FEATURES], float)
    return features.withColumns(dict(zip(FEATURES, _scaled(mean, np.where(scale > 0, scale, np.inf)))))


def _scaled(mean: np.ndarray, scale: np.ndarray) -> list[Column]:
    return [(F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(FEATURES, mean, scale)]


def _sample(features: DataFrame, n: int) -> np.ndarray:
    """About ``SEEDING_ROWS`` of the n rows, in an order of their own."""
    share = min(1.0, SEEDING_ROWS / max(1, n))
    drawn = F.pmod(F.xxhash64(*features.columns), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    chosen = features.where(drawn).select(*[F.col(c).cast("double") for c in FEATURES])
    rows = np.array([tuple(r) for r in chosen.collect()], float).reshape(-1, len(FEATURES))
    return rows[np.lexsort(rows.T)]


def first_centres(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows, each the best of a few drawn with a chance that grows with the square of the distance from those before it."""
    rng = np.random.default_rng(seed)
    if not len(rows):
        return rng.normal(size=(k, rows.shape[1]))
    chosen = [rows[rng.integers(len(rows))]]
    while len(chosen) < k:
        distance = np.min([((rows - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        total = distance.sum()
        if total > 0:
            drawn = rows[rng.choice(len(rows), size=2 + int(np.log(k)), p=distance / total)]
            left = [np.minimum(distance, ((rows - c) ** 2).sum(axis=1)).sum() for c in drawn]
            chosen.append(drawn[int(np.argmin(left))])
        else:
            chosen.append(chosen[0] + rng.normal(size=rows.shape[1]))
    return np.array(chosen)


def best_clustering(
    points: DataFrame, starts: np.ndarray, max_iter: int, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lloyd's rounds from every start at once; centres of the cheapest one, with the sums and numbers of their rows.

    ``starts`` is (start, cluster, column); ``points`` are double columns. An empty cluster stays where it is.
    """
    centres = starts.copy()
    cost = np.full(len(starts), np.inf)
    sums, n = np.zeros_like(starts), np.zeros(starts.shape[:2])
    moving = np.arange(len(starts))
    for _ in range(max(1, max_iter)):
        cost[moving], sums[moving], n[moving] = _round(points, centres[moving])
        after = np.where(n[moving, :, None] > 0, sums[moving] / np.maximum(n[moving, :, None], 1), centres[moving])
        far = np.sqrt(((after - centres[moving]) ** 2).sum(axis=2)).max(axis=1) > tolerance
        centres[moving[far]] = after[far]
        moving = moving[far]
        if not len(moving):
            break
    if len(moving):  # cut short: the costs are those before the last move
        cost[moving], sums[moving], n[moving] = _round(points, centres[moving])
    best = int(np.argmin(cost))
    return centres[best], sums[best], n[best]


def _round(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost per start, and sums and numbers of the rows nearest to each centre: one pass."""
    starts, k, width = centres.shape
    sums = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((starts, k, width + 2))  # sums, number, cost
        for batch in batches:
            everything = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for at in range(0, len(everything), _CHUNK):
                x = everything[at : at + _CHUNK]
                for start in range(starts):
                    distance = ((x[:, None, :] - centres[start][None]) ** 2).sum(axis=2)
                    nearest = distance.argmin(axis=1)
                    mine = np.zeros((len(x), k))
                    mine[np.arange(len(x)), nearest] = 1.0
                    totals[start, :, :width] += mine.T @ x
                    totals[start, :, width] += mine.sum(axis=0)
                    totals[start, :, width + 1] += mine.T @ distance.min(axis=1)
        start, cluster = np.divmod(np.arange(starts * k), k)
        flat = totals.reshape(-1, width + 2)
        columns = [pa.array(start), pa.array(cluster), *[pa.array(flat[:, i]) for i in range(width + 2)]]
        yield pa.RecordBatch.from_arrays(columns, ["start", "cluster", *sums, "n", "cost"])

    schema = ", ".join(["start long", "cluster long", *[f"{c} double" for c in [*sums, "n", "cost"]]])
    added = points.mapInArrow(run, schema).groupBy("start", "cluster").agg(*[F.sum(c).alias(c) for c in [*sums, "n", "cost"]])
    totals = np.zeros((starts, k, width + 2))
    for row in added.collect():  # one row per start and cluster
        totals[row.start, row.cluster] = row[2:]
    return totals[:, :, width + 1].sum(axis=1), totals[:, :, :width], totals[:, :, width]


def _nearest(centres: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Column:
    """Number of the centre nearest to a row's features; of equally near ones the first."""

    def distance(centre: np.ndarray) -> Column:
        parts = [own - F.lit(float(x)) for own, x in zip(_scaled(mean, scale), centre)]
        return reduce(add, [p * p for p in parts])

    distances = F.array(*[distance(c) for c in centres])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def segment_margins(segments: DataFrame) -> DataFrame:
    """Customers and mean margin per segment, and the segment's place by margin; unplaced customers are left out."""
    per_label = segments.where(F.col("segment_label").isNotNull()).groupBy("segment_label").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("margin").alias("mean_margin")
    )
    return per_label.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_margin"))))
