"""Load only the captures that arrived or changed since the last run.

A file stream remembers which capture files it has seen. It only tells which capture directories
new files are in; those directories are then loaded whole, with the same reading and writing as
:func:`tallyline.sources.snapshots.load_snapshots`. So it does not matter how files fall into
batches, whether a batch is repeated after a failure, or whether a file reaches a directory late.
Everything derived from items looks ahead in time and stays a batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.sources.snapshots import FILE_NAME, lake_glob, load_paths
from tallyline.sources.warehouse import Warehouse

# What Spark's source of whole files gives; only the path is read.
_FILES = "path string, modificationTime timestamp, length long, content binary"


def load_new_snapshots(
    warehouse: Warehouse,
    lake_root: str,
    progress: str,
    host: str = "*",
    file_name: str = FILE_NAME,
    files_per_batch: int = 10_000,
) -> None:
    """Load the capture directories of all new files, in bounded batches, then return.

    ``progress`` is a shared folder that keeps the stream's state between runs. A batch asks for no
    more directories than it has files.
    """

    def load(batch: DataFrame, _: int) -> None:
        directories = [row.directory for row in batch.distinct().collect()]
        if directories:
            load_paths(warehouse, directories, file_name)

    files = (
        warehouse.spark.readStream.schema(_FILES)
        .format("binaryFile")
        .option("pathGlobFilter", file_name)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(lake_glob(lake_root, host))
        .select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"))
    )
    query = (
        files.writeStream.foreachBatch(load)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
