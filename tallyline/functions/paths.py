"""Columns read off the path of a capture file: ``…/<host>/<day>_<second>/<file>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats: a host name, and five digits of day with one to five digits of second.
HOST_NAME = r"^[A-Za-z0-9._-]+$"
SNAPSHOT_NAME = r"^\d{5}_\d{1,5}$"


def _element(path: Column, from_end: int) -> Column:
    """A path element counted from the end, without the ``key=`` of a Hive-style directory
    (``host=mongo01``), which is how Spark itself lays out a partitioned write."""
    name = F.substring_index(F.substring_index(path, "/", -from_end), "/", 1)
    return F.substring_index(name, "=", -1)


def snapshot_path_columns(path: Column) -> list[Column]:
    """Host, day and second of a capture; all three NULL when the path does not match.

    The elements are cut out by plain substring functions and only then matched, because this
    runs for every row and a pattern over the whole path costs several times as much.
    """
    host, snapshot = _element(path, 3), _element(path, 2)
    matches = snapshot.rlike(SNAPSHOT_NAME) & host.rlike(HOST_NAME)
    return [
        F.when(matches, host).alias("mongo_hostname"),
        F.when(matches, F.substring_index(snapshot, "_", 1))
        .try_cast("int")
        .alias("days_post_epoch"),
        F.when(matches, F.substring_index(snapshot, "_", -1))
        .try_cast("int")
        .alias("seconds_of_day"),
    ]
