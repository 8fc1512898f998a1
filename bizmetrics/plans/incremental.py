"""Sales results kept up to date from new files only.

A store keeps the additive rollups of every sales file it has read, in parts: one part per refresh, normally one new month. Sums,
counts and extremes add up, so a refresh reads the lines of new files only, whatever the history holds. What does not add up
is the lags and rolling values of a series (product and region); they are computed again for the series that the
new lines touch, from the rollups, and the other series keep what they have.

Every refresh is a version of a ``Snapshots`` folder: readers see a whole state, before or after. A file that changed or went cannot be
taken out of a sum: then all files are read again. Many parts are merged into one, from the rollups.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import temporary_tables
from bizmetrics.functions.measures import SalesRollups, merge_sales_rollups, read_sales_rollups, sales_rollups, write_sales_rollups
from bizmetrics.operators.sales import monthly_panel, panel_features
from bizmetrics.sources.snapshot import Snapshots, Version, input_files

SERIES = ["product_id", "region"]
#: Parts that reads put together, at most.
MOST_PARTS = 12


class SalesStore:
    """Rollups and panel features of the sales files read so far, at ``path``.

    ``bounds`` are those of the decisions; a store made with others is built anew.
    """

    def __init__(self, spark: SparkSession, path: str, most_parts: int = MOST_PARTS, **bounds: float) -> None:
        self.spark, self.most_parts, self.bounds = spark, most_parts, bounds
        self.snapshots = Snapshots(spark, path)

    def refresh(self, sales_path: str, read: Callable[[list[str]], DataFrame]) -> Version:
        """Take in the files below ``sales_path`` that the store does not have; ``read`` gives the lines of some files.

        The version's notes tell the ``lines`` and ``files`` read and whether everything was ``rebuilt``.
        """
        files = input_files(self.spark, sales_path)
        last = self._latest()
        if last is not None:
            known = self.spark.read.parquet(f"{last.path}/files")
            keys = ["path", "length", "modified"]
            fresh = files.join(known, keys, "left_anti")
            if not known.join(files, keys, "left_anti").isEmpty():
                last, fresh = None, files
        else:
            fresh = files
        # Names of files, as Spark's own reader holds them.
        paths = [row.path for row in fresh.select("path").collect()]
        if last is not None and not paths:
            return last

        def write(content: str) -> dict:
            listed = self.spark.createDataFrame([(p,) for p in paths], "path string")
            taken = files.join(listed, "path", "left_semi")
            (taken if last is None else known.unionByName(taken)).write.parquet(f"{content}/files")
            return self._add(content, read(paths), last) | {"files": len(paths), "rebuilt": last is None}

        with temporary_tables(self.spark):
            return self.snapshots.commit(write, self._made_from())

    def rollups(self, version: Version | None = None) -> SalesRollups:
        """The rollups over all parts of a version (default: the latest)."""
        version = version or self._latest()
        if version is None:
            raise ValueError("the store is empty: refresh it first")
        return merge_sales_rollups([read_sales_rollups(self.spark, f"{p}/rollups") for p in self._parts(version)])

    def features(self, version: Version | None = None) -> DataFrame:
        """The panel features: of each series, those of the last part that touched it."""
        version = version or self._latest()
        if version is None:
            raise ValueError("the store is empty: refresh it first")
        *earlier, newest = self._parts(version)
        found, later = self._features(newest), self._series(newest)
        for part in reversed(earlier):
            found = found.unionByName(self._features(part).join(later, SERIES, "left_anti"))
            later = later.unionByName(self._series(part))
        return found

    def _add(self, content: str, lines: DataFrame, last: Version | None) -> dict:
        """Save the part of some new lines; its notes."""
        counted = Observation()
        lines = lines.observe(counted, F.count(F.lit(1)).alias("lines"))
        earlier = last.notes["parts"] if last is not None else []
        merging = len(earlier) + 1 > self.most_parts
        new = sales_rollups(lines, None if merging else f"{content}/rollups", **self.bounds)
        touched = new.products.select(*SERIES).distinct()
        merged = new if last is None else merge_sales_rollups([self.rollups(last), new])
        features = panel_features(monthly_panel(merged.products.join(touched, SERIES, "left_semi")))
        if merging:
            features = features.unionByName(self.features(last).join(touched, SERIES, "left_anti"))
            touched = merged.products.select(*SERIES).distinct()
            write_sales_rollups(merged, f"{content}/rollups")
        features.write.parquet(f"{content}/features")
        touched.write.parquet(f"{content}/series")
        needs = [] if merging else earlier
        return {"lines": counted.get["lines"], "needs": needs, "parts": [*needs, content.rstrip("/").split("/")[-2]]}

    def _latest(self) -> Version | None:
        return self.snapshots.latest(self._made_from())

    def _made_from(self) -> str:
        return json.dumps(self.bounds, sort_keys=True)

    def _parts(self, version: Version) -> list[str]:
        return [self.snapshots.content(name) for name in version.notes["parts"]]

    def _features(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{part}/features")

    def _series(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{part}/series")
