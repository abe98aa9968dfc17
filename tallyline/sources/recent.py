"""Load what has come since the last load, without listing what was loaded before.

The manifest knows the last day of every host. For these hosts only directories of that day and later
ones are asked for, by a pattern on the five digits of the day; the last day itself is loaded again, as
captures of it may have come late. Hosts that the manifest does not know are loaded whole. Only the
names that match reach the driver, and only their files are listed and read.

A capture that comes later than its host's next day is not found here: the file stream of
:mod:`tallyline.streaming.ingest`, which extends the same manifest, or a load of its directory does.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from tallyline.schema import DAY, HOST, LOAD_MANIFEST
from tallyline.sources.scratch import names_matching
from tallyline.sources.snapshots import FILE_NAME, load_paths

DAY_DIGITS = 5


def from_day(day: int) -> str:
    """Pattern of all five-digit days from a given one on."""
    digits = f"{day:0{DAY_DIGITS}d}"
    patterns = [digits]
    for k, digit in enumerate(digits):
        if digit != "9":
            patterns.append(f"{digits[:k]}[{int(digit) + 1}-9]" + "?" * (DAY_DIGITS - 1 - k))
    return "{" + ",".join(patterns) + "}"


def recent_directories(warehouse, lake_root: str) -> Iterator[str]:
    """Capture directories of unknown hosts, and of known ones from their last day on. Host directories
    may be named as Spark names them (``mongo_hostname=<host>``)."""
    known = warehouse.read(LOAD_MANIFEST.name).groupBy(HOST).agg(F.max(DAY).alias("day"))
    last = {row[HOST]: row["day"] for row in known.toLocalIterator()}
    root = lake_root.rstrip("/")
    for folder in names_matching(warehouse.spark, f"{root}/*"):
        host = folder.rsplit("=", 1)[-1]
        days = from_day(last[host]) if host in last else "*"
        for name in names_matching(warehouse.spark, f"{root}/{folder}/*{days}_*" if "=" in folder else f"{root}/{folder}/{days}_*"):
            yield f"{root}/{folder}/{name}"


def load_recent(warehouse, lake_root: str, file_name: str = FILE_NAME, per_load: int = 10_000) -> int:
    """Load these directories, at most ``per_load`` at once; returns how many there were."""
    total, held = 0, []
    for directory in recent_directories(warehouse, lake_root):
        held.append(directory)
        total += 1
        if len(held) == per_load:
            load_paths(warehouse, held, file_name)
            held = []
    if held:
        load_paths(warehouse, held, file_name)
    return total
