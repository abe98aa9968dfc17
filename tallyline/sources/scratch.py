"""Folders for intermediate tables, shared by every executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Folders made so far and not removed, by application.
_made: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to a
    machine-local folder; elsewhere such a folder would be lost with its machine.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_SETTING} must name a shared folder on a cluster")
    return tempfile.gettempdir()


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that no other run uses; Spark creates it on write.

    What is in it is removed by :func:`release`, at the latest when the driver ends: the results of
    queries are read from such folders for as long as they are used.
    """
    path = f"{shared_root(spark)}/tallyline-{purpose}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, keep: int = 0) -> None:
    """Remove the scratch folders of this application, but for the first ``keep``."""
    _remove(spark.sparkContext, keep)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made inside are removed at the end, whether or not it succeeds; for jobs that
    leave nothing to be read from them."""
    before = len(_made.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def path_exists(spark: SparkSession, folder: str) -> bool:
    files, path = _place(spark.sparkContext, folder)
    return files.exists(path)


def remove_path(spark: SparkSession, folder: str) -> None:
    files, path = _place(spark.sparkContext, folder)
    files.delete(path, True)


def names_matching(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders that match a pattern of the file system."""
    files, path = _place(spark.sparkContext, pattern)
    return [status.getPath().getName() for status in files.globStatus(path) or [] if status.isDirectory()]


def _place(context: SparkContext, folder: str):
    """A folder and the file system that it is on."""
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def _remove(context: SparkContext, keep: int) -> None:
    folders = _made.get(context.applicationId, [])
    for folder in folders[keep:]:
        files, path = _place(context, folder)
        files.delete(path, True)
    del folders[keep:]


@atexit.register
def _release_at_exit() -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        _remove(context, 0)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back.

    Cuts the lineage, so a lost executor costs a re-read only, and gives the planner true file
    sizes: a join side is broadcast only if it is under ``autoBroadcastJoinThreshold``.
    """
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """The same for what ``make`` returns; the scratch tables made on the way there are removed."""
    path = scratch_folder(spark, purpose)
    with temporary(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
