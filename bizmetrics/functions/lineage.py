"""Results that several later steps read are written once to the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Tables made inside each ``temporary_tables`` block that is open.
_open_blocks: list[list[str]] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """This application's part of ``spark.checkpoint.dir``; where that is unset, of the warehouse folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            # The warehouse is shared like the tables in it.
            shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_bizmetrics_checkpoint"
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def new_table(spark: SparkSession) -> str:
    """Path of a table that is not there yet, in the checkpoint folder."""
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    for block in _open_blocks:
        block.append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, when the block ends, every intermediate table made in it: for work whose result is saved elsewhere.

    Tables that other threads make meanwhile count as the block's own.
    """
    made: list[str] = []
    _open_blocks.append(made)
    try:
        yield
    finally:
        _open_blocks[:] = [block for block in _open_blocks if block is not made]
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet to the checkpoint folder and read on from there.

    The files outlive a lost executor. Later steps read only the columns they need, and
    Spark knows the table's size when it picks a join.
    """
    path = new_table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote, once all that was made of them is written too."""
    for table in tables:
        folder = checkpoint_folder(table.sparkSession).rstrip("/")
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if f"/{folder.rsplit('/', 1)[-1]}/table-" not in path:
                raise ValueError(f"not a table of this application's checkpoint folder: {path}")
            _delete(table.sparkSession, path)
