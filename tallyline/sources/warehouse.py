"""Partitioned ORC or Parquet tables under one root."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.schema import COLLECTION, TABLES
from tallyline.sources import publications
from tallyline.sources.scratch import path_exists, remove_path, scratch_folder

FORMATS = ("orc", "parquet")
# The path schemes a root may use; otherwise it must be absolute.
SCHEMES = ("s3a", "s3", "hdfs", "gs", "abfs", "file")


def validate_root(root: str) -> str:
    if not root:
        raise ValueError("the warehouse root is empty")
    scheme = re.match(r"([A-Za-z0-9+.-]+)://", root)
    if not (root.startswith("/") or (scheme and scheme.group(1) in SCHEMES)):
        raise ValueError(
            f"{root!r} is neither absolute nor on one of the schemes {', '.join(SCHEMES)}"
        )
    return root.rstrip("/") or "/"


def infer_format(root: str, explicit: str | None = None) -> str:
    """The given format, else the one format name that occurs as a part of the path."""
    if explicit is not None:
        if explicit not in FORMATS:
            raise ValueError(f"unknown warehouse format {explicit!r}")
        return explicit
    named = [fmt for fmt in FORMATS if fmt in PurePosixPath(root).parts]
    if len(named) != 1:
        raise ValueError(f"cannot tell the format of {root!r}; name one of {', '.join(FORMATS)}")
    return named[0]


class Warehouse:
    """Tables of :mod:`tallyline.schema`, read with their declared schema.

    A write replaces only the partitions present in the new data; what a source no longer has is
    removed by :meth:`drop` or :meth:`keep_only`. Published tables are written as generations, see
    :mod:`tallyline.sources.publications`.
    """

    def __init__(self, spark: SparkSession, root: str, fmt: str | None = None) -> None:
        self.spark = spark
        self.root = validate_root(root)
        self.fmt = infer_format(self.root, fmt)

    @classmethod
    def scratch(cls, spark: SparkSession, fmt: str = "parquet") -> Warehouse:
        """A warehouse in the shared scratch folder, on whatever scheme the cluster gave it."""
        warehouse = cls.__new__(cls)
        warehouse.spark, warehouse.root = spark, scratch_folder(spark, "warehouse")
        warehouse.fmt = infer_format(warehouse.root, fmt)
        return warehouse

    def path(self, name: str) -> str:
        return f"{self.root}/{TABLES[name].name}"

    def exists(self, name: str) -> bool:
        return path_exists(self.spark, self.path(name))

    def read(self, name: str) -> DataFrame:
        """The declared schema keeps partition values as they are: host ``0456`` stays a string,
        and no footer has to be opened for inference. A log that has no rows yet is empty."""
        table = TABLES[name]
        if table.published:
            return publications.read(self, name)
        if table.log and not self.exists(name):
            return self.spark.createDataFrame([], table.schema)
        rows = self.spark.read.schema(table.schema).format(self.fmt).load(self.path(name))
        return rows.select(*table.schema.names)

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the partitions that occur in ``df``; of a published table, the hosts."""
        if TABLES[name].published:
            generation = publications.Generation(self)
            generation.write(name, df)
            generation.publish(generation.hosts(name))
        else:
            self.save(name, df, self.path(name))

    def save(self, name: str, df: DataFrame, path: str, pieces: int = 1) -> None:
        """Write the rows of a table under ``path``, a partition directory in so many ``pieces`` by
        collection: few directories of many rows are then sorted by more tasks, less in each.

        The rebalance hint groups rows by partition directory so that each gets few files, and
        lets the adaptive planner split a directory that is far larger than the others. Rows are
        ordered inside each task only; a global sort would add a range exchange for an order
        that a partitioned table does not keep.
        """
        table = TABLES[name]
        rows = df.select(*(F.col(f.name).cast(f.dataType) for f in table.schema))
        order = [F.col(key) for key in table.partition_by] + [_ordering(key) for key in table.order]
        keys = list(table.partition_by)
        if pieces > 1:
            rows, keys = rows.withColumn("piece", F.pmod(F.hash(COLLECTION), F.lit(pieces))), [*keys, "piece"]
        (
            rows.hint("rebalance", *keys)
            .sortWithinPartitions(*order)
            .drop("piece")
            .write.partitionBy(*table.partition_by)
            .options(**bloom_filters(self.fmt, table.lookup))
            .option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .format(self.fmt)
            .save(path)
        )

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a table that keeps a row for every run; the time of the run is set here."""
        table = TABLES[name]
        rows = df.withColumn("LoadedAt", F.current_timestamp())
        (
            rows.select(*(F.col(f.name).cast(f.dataType) for f in table.schema))
            .sortWithinPartitions(*map(_ordering, table.order))
            .write.partitionBy(*table.partition_by)
            .mode("append")
            .format(self.fmt)
            .save(self.path(name))
        )

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write, then read back: later steps start from stored files, not from a long lineage."""
        self.write(name, df)
        return self.read(name)

    def partitions(self, name: str) -> DataFrame:
        """The partitions of a table that hold rows. Only the files' footers are read."""
        keys = TABLES[name].partition_by
        if not self.exists(name):
            return self.spark.createDataFrame([], TABLES[name].schema).select(*keys)
        return self.read(name).select(*keys).distinct()

    def drop(self, name: str, keys: DataFrame) -> None:
        """Remove partitions. Their names come to the driver, one per directory that goes."""
        columns = TABLES[name].partition_by
        for row in keys.select(*columns).distinct().toLocalIterator():
            parts = "/".join(f"{column}={row[column]}" for column in columns)
            remove_path(self.spark, f"{self.path(name)}/{parts}")

    def keep_only(self, name: str, keys: DataFrame) -> None:
        """Remove the partitions that are not among ``keys`` (any columns that partition the table)."""
        self.drop(name, self.partitions(name).join(keys, keys.columns, "left_anti"))


def bloom_filters(fmt: str, columns: tuple[str, ...]) -> dict[str, str]:
    """Options of the file formats that let a look-up of one value skip what does not hold it."""
    if fmt == "orc":
        return {"orc.bloom.filter.columns": ",".join(columns)} if columns else {}
    return {f"parquet.bloom.filter.enabled#{column}": "true" for column in columns}


def _ordering(key: str) -> Column:
    return F.col(key[1:]).desc() if key.startswith("-") else F.col(key)
