"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
"""Paths of the tables that the innermost open block has stored."""


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or else the context's checkpoint folder.

    Only a local-mode session with neither gets a folder of its own.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    context.setCheckpointDir("file://" + tempfile.mkdtemp(dir="/tmp/checkpoints"))
    return context.getCheckpointDir()


def _at(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as that takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes with the tables that are stored there (see stored)."""
    own = f"{shared_dir(spark).rstrip('/')}/kerbline-{spark.sparkContext.applicationId}"
    path = f"{own}/{uuid.uuid4().hex}"
    files, folder = _at(spark, own)
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    if (written := _written.get()) is not None:
        written.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors.

    The table stays until the block of settled() that wrote it ends, or else until the driver does: results are lazy and may read it.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stored inside the block are removed at its end, but for those that are taken from the list."""
    written: list[str] = []
    token = _written.set(written)
    try:
        yield written
    finally:
        _written.reset(token)
        for path in written:
            files, folder = _at(spark, path)
            files.delete(folder, True)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """What build() returns, stored; all tables that it stored on the way are removed, as nothing needs them any more."""
    outer = _written.get()
    with scratch(SparkSession.active()) as written:
        out = stored(build())
        kept = written.pop()
    if outer is not None:
        outer.append(kept)
    return out
