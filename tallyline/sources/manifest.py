"""Which captures a load has touched, whether or not they held any row.

The rows of a load cannot tell that a capture has become empty. The files can: every capture
directory with a file of the load is touched, and so is every directory that was named itself, even
if no file is left in it. Each load writes its touched captures to a numbered part of the manifest
before it changes anything, so a load that fails half-way is known too. From the manifest follow the
partitions to remove and the hosts whose labels have to be made anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.paths import snapshot_path_columns
from tallyline.schema import HOST, LOAD_MANIFEST, SNAPSHOT

# Characters that make a path a pattern.
_PATTERN = set("*?[]{}")


def touched_captures(spark: SparkSession, paths: str | Sequence[str], file_name: str) -> DataFrame:
    """Host, day and second of the captures under ``paths``, with their number of files. Files are
    listed, not opened; what is no capture directory is left out."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("pathGlobFilter", file_name).load(paths).select("path", F.lit(1).alias("file"))
    named = [(f"{p.rstrip('/')}/{file_name}", 0) for p in paths if not _PATTERN & set(p)]
    if named:
        files = files.union(spark.createDataFrame(named, "path string, file int"))
    return (
        files.select(*snapshot_path_columns(F.col("path")), "file")
        .where(F.col(HOST).isNotNull())
        .groupBy(*SNAPSHOT)
        .agg(F.sum("file").cast("long").alias("FileCount"))
    )


def last_load(warehouse) -> int:
    """The number of the last load, 0 before the first."""
    return warehouse.read(LOAD_MANIFEST.name).agg(F.max("Load")).first()[0] or 0


def record(warehouse, touched: DataFrame) -> int:
    """Note the captures of a new load; returns its number."""
    load = last_load(warehouse) + 1
    rows = touched.select(*SNAPSHOT, "FileCount", F.current_timestamp().alias("LoadedAt"))
    rows.write.mode("error").format(warehouse.fmt).save(f"{warehouse.path(LOAD_MANIFEST.name)}/Load={load}")
    return load


def touched_since(warehouse, load: int) -> DataFrame:
    """Captures touched by the loads after a given one."""
    return warehouse.read(LOAD_MANIFEST.name).where(F.col("Load") > load).select(*SNAPSHOT).distinct()


def emptied(warehouse, name: str, touched: DataFrame, rows: DataFrame) -> DataFrame:
    """The touched captures that a table holds and the new rows do not. A load of new captures finds
    that the table holds none, and does not look at its rows for this."""
    known = touched.select(*SNAPSHOT).join(warehouse.partitions(name), SNAPSHOT, "left_semi")
    if known.isEmpty():
        return known
    filled = rows.join(known, SNAPSHOT, "left_semi").select(*SNAPSHOT).distinct()
    return known.join(filled, SNAPSHOT, "left_anti")
