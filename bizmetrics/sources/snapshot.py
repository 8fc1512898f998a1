"""Saving results and reading them back, in versions.

A snapshot folder holds

- ``versions/<name>/``: what one writer saved, with ``whole.json`` written last: what it was made from, and how many files and
  bytes it has;
- ``log/<number>.json``: which version is number 1, 2, ... A number is taken by renaming a draft to it, which fails when
  another writer has it; that writer takes the next one.

A version is read only if it is in the log and as large as it says, and so are the versions it says it needs. A writer that dies leaves a version outside the log; a
version that lost files is passed over for the one before it. Nothing that readers may be reading is overwritten or moved.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bizmetrics.functions.lineage import temporary_tables

_DATES = {"dateFormat": "yyyy-MM-dd"}
#: Versions kept when a new one is committed, and hours that a folder outside the log may be somebody's work.
KEEP = 3
GRACE_HOURS = 24.0


class SharedFolder:
    """A folder in any store that Spark reaches, for small files and their names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        root = self._path("")
        self._fs = root.getFileSystem(self._conf)
        self._whole_path = self._fs.makeQualified(root).toString().rstrip("/")

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> dict[str, float]:
        """Names in a folder, with their time of change in seconds; empty if there is no such folder."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._fs.listStatus(path)}

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Put a whole file where there is none; False if there is one."""
        draft, target = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(name)
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # The file context's rename never overwrites, unlike the file system's.
        whole = lambda path: self._hadoop.Path(path.toString().replace(self.path, self._whole_path, 1))
        context = self._hadoop.FileContext.getFileContext(whole(target).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(whole(draft), whole(target), options)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    def size(self, name: str) -> tuple[int, int]:
        """Files and bytes below a folder; zeros if it is not there."""
        path = self._path(name)
        if not self._fs.exists(path):
            return 0, 0
        summary = self._fs.getContentSummary(path)
        return summary.getFileCount(), summary.getLength()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Version:
    """A committed version: its number and name, the folder of its content, and what was noted about it."""

    number: int
    name: str
    path: str
    made_from: str
    notes: dict[str, Any] = field(default_factory=dict)


class Snapshots:
    """The versions of one snapshot folder."""

    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP, grace_hours: float = GRACE_HOURS) -> None:
        if keep < 1:
            raise ValueError("at least the last version is kept")
        self.spark, self.folder, self.keep, self.grace_hours = spark, SharedFolder(spark, path), keep, grace_hours

    def versions(self) -> Iterator[Version]:
        """Whole versions, the latest first."""
        for number in self._numbers():
            if (version := self._version(number)) is not None:
                yield version

    def latest(self, made_from: str | None = None) -> Version | None:
        """The latest whole version, or the latest of those made from the same (see ``fingerprint``)."""
        return next((v for v in self.versions() if made_from in (None, v.made_from)), None)

    def commit(self, write: Callable[[str], dict[str, Any] | None], made_from: str = "") -> Version:
        """Save what ``write`` puts into the folder it is given; it may return notes to keep with the version.

        Until this returns, readers see the versions before. Names of versions under ``needs`` in the notes are kept as long as
        this one.
        """
        name = uuid.uuid4().hex
        content = self.content(name)
        notes = write(content) or {}
        files, size = self.folder.size(f"versions/{name}/content")
        whole = {"made_from": made_from, "notes": notes, "files": files, "bytes": size}
        self.folder.write_new(f"versions/{name}/whole.json", json.dumps(whole))
        number = max(self._numbers(), default=0) + 1
        while not self.folder.write_new(f"log/{number:012d}.json", json.dumps({"version": name})):
            number += 1
        self._sweep()
        return Version(number, name, content, made_from, notes)

    def content(self, name: str) -> str:
        """The folder of a version's content, by the version's name."""
        return f"{self.folder.path}/versions/{name}/content"

    def _numbers(self) -> list[int]:
        logged = [n.removesuffix(".json") for n in self.folder.names("log") if n.endswith(".json")]
        return sorted((int(n) for n in logged if n.isdigit()), reverse=True)

    def _named(self, number: int) -> str | None:
        entry = self.folder.read(f"log/{number:012d}.json")
        return None if entry is None else json.loads(entry)["version"]

    def _whole(self, name: str) -> dict[str, Any] | None:
        saved = self.folder.read(f"versions/{name}/whole.json")
        whole = None if saved is None else json.loads(saved)
        if whole is None or self.folder.size(f"versions/{name}/content") != (whole["files"], whole["bytes"]):
            return None
        return whole

    def _version(self, number: int) -> Version | None:
        name = self._named(number)
        whole = None if name is None else self._whole(name)
        if whole is None or any(self._whole(other) is None for other in whole["notes"].get("needs", [])):
            return None
        return Version(number, name, self.content(name), whole["made_from"], whole["notes"])

    def _sweep(self) -> None:
        """Remove what no reader can need: log entries beyond the last ``keep`` and old folders outside the log."""
        numbers = self._numbers()
        kept = {self._named(n) for n in numbers[: self.keep]}
        for name in list(kept):
            whole = self._whole(name) if name else None
            kept |= set(whole["notes"].get("needs", [])) if whole else set()
        for number in numbers[self.keep :]:
            self.folder.delete(f"log/{number:012d}.json")
        oldest = time.time() - self.grace_hours * 3600
        for kind in ("versions", "drafts"):
            for name, changed in self.folder.names(kind).items():
                if name not in kept and changed < oldest:
                    self.folder.delete(f"{kind}/{name}")


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of every file that a read of ``path`` takes. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def fingerprint(spark: SparkSession, paths: dict[str, str], options: dict[str, Any]) -> str:
    """Text that differs when an option or an input file (its path, size or time of change) does.

    The files are listed and hashed by Spark; one row per path reaches the driver. Tables among the options count by
    their rows.
    """
    found = {name: _digest(input_files(spark, path)) for name, path in sorted(paths.items())}
    chosen = {k: _digest(v) if isinstance(v, DataFrame) else v for k, v in sorted(options.items())}
    return json.dumps({"files": found, "options": chosen}, sort_keys=True, default=str)


def _digest(rows: DataFrame) -> list:
    """Number of rows and two sums of hashes that do not depend on their order."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    first, second = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    return list(rows.agg(F.count(F.lit(1)), F.bit_xor(first), F.sum(second.cast("decimal(38,0)")).cast("string")).first())


def write_report(report: DataFrame, path: str) -> None:
    """Save the one-row report as JSON, with its schema next to it."""
    report.write.mode("overwrite").options(**_DATES).json(f"{path}/report")
    schema = report.sparkSession.createDataFrame([(report.schema.json(),)], "value string")
    schema.coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """The report saved by ``write_report``, or None when there is none."""
    try:
        saved = spark.read.text(f"{path}/schema").first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    schema = StructType.fromJson(json.loads(saved.value))
    return spark.read.schema(schema).options(**_DATES).json(f"{path}/report")


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False, made_from: str = ""
) -> DataFrame:
    """The saved report made from the same, if there is one and no refresh is asked for; else build, save and read it."""
    snapshots = Snapshots(spark, path)
    version = None if refresh else snapshots.latest(made_from)
    if version is None:
        with temporary_tables(spark):
            version = snapshots.commit(lambda content: write_report(build(), content), made_from)
    return read_report(spark, version.path)


def write_tables(results: dict[str, DataFrame], path: str) -> None:
    """Save each result table as Parquet in its own folder."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
