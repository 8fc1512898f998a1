"""Whole files in the folder that driver and executors share.

Tasks write a file under a name of their own and move it into place when it is complete, so a task that is run again
replaces the file by an equal one and a half-written file is never read.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession

from bizmetrics.functions.lineage import checkpoint_folder


def output_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application's part of ``spark.checkpoint.dir``, as a URI or a path."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def locate(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI (file, s3, gs, hdfs) or of an absolute path."""
    if uri.startswith("/"):
        return arrow_fs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return arrow_fs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(uri: str):
    """Output stream whose content appears at ``uri`` when the block ends without an error."""
    system, path = locate(uri)
    draft = f"{path}.{uuid.uuid4().hex}"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    try:
        with system.open_output_stream(draft) as out:
            yield out
    except BaseException:
        system.delete_file(draft)
        raise
    system.move(draft, path)


def read_part(uri: str, start: int, length: int) -> bytes:
    system, path = locate(uri)
    with system.open_input_file(path) as source:
        return source.read_at(length, start)
