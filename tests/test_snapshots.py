"""Loading delimited captures from plain directories."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyline.sources import snapshots
from tallyline.sources.snapshots import (
    FILE_NAME,
    lake_glob,
    load_issues,
    load_paths,
    load_snapshots,
    path_partition_columns,
    placed_items,
    read_snapshots,
    write_snapshots,
)
from tallyline.sources.warehouse import Warehouse
from tallyline.streaming.ingest import load_new_snapshots

HEADER = "VariomeName|IndexName|UseCount|Since\n"
SINCE = "2024-01-01 10:00:00.250 +0000 UTC"


def capture(root: Path, host: str, snapshot: str, *lines: str) -> None:
    folder = root / host / snapshot
    folder.mkdir(parents=True)
    (folder / FILE_NAME).write_text(HEADER + "".join(line + "\n" for line in lines))


def read(spark, root: Path):
    return read_snapshots(spark, lake_glob(str(root)))


def test_columns_by_position_and_path(spark, tmp_path):
    capture(tmp_path, "db-1.example", "19723_36000", f'c|{{ "a" : 1 }}|7|{SINCE}')
    capture(tmp_path, "0456", "19724_5", f"c|i|8|{SINCE}")
    rows = {r.mongo_hostname: r for r in placed_items(read(spark, tmp_path)).collect()}
    assert rows.keys() == {"db-1.example", "0456"}
    row = rows["db-1.example"]
    assert (row.CollectionName, row.IndexName, row.UseCount) == ("c", '{ "a" : 1 }', 7)
    assert (row.days_post_epoch, row.seconds_of_day) == (19723, 36000)
    assert row.Since == datetime(2024, 1, 1, 10, 0, 0, 250000)
    assert (rows["0456"].days_post_epoch, rows["0456"].seconds_of_day) == (19724, 5)


@pytest.mark.parametrize(
    "text,micros",
    [
        ("2024-01-01 10:00:00 +0000 UTC", 0),
        ("2024-01-01 10:00:00.1 +0000 UTC", 100000),
        ("2024-01-01 10:00:00.123 +0000 UTC", 123000),
        ("2024-01-01 10:00:00.123456 +0000 UTC", 123456),
        ("2024-01-01 10:00:00.123456789 +0000 UTC", 123456),
        ("yesterday", None),
    ],
)
def test_since_fractions(spark, tmp_path, text, micros):
    capture(tmp_path, "h", "19723_1", f"c|i|7|{text}")
    (row,) = placed_items(read(spark, tmp_path)).collect()
    expected = None if micros is None else datetime(2024, 1, 1, 10, 0, 0, micros)
    assert row.Since == expected


def test_bad_fields_and_places_are_reported(spark, tmp_path):
    capture(tmp_path, "h", "19723_1", f"c|i|99999999999999999999|{SINCE}", f"c|j|1|{SINCE}")
    capture(tmp_path, "h", "19723_1234567", f"c|i|1|{SINCE}")
    capture(tmp_path, "h", "19724_1", f"c|i|1|{SINCE}")
    lines = read(spark, tmp_path)
    items = placed_items(lines)
    assert {(r.days_post_epoch, r.IndexName, r.UseCount) for r in items.collect()} == {
        (19723, "i", None), (19723, "j", 1), (19724, "i", 1),
    }
    issues = {
        r.file_path.split("/")[-2]: (r.LineCount, r.UnplacedCount, r.CorruptCount, r.NullUseCountCount)
        for r in load_issues(lines).collect()
    }
    assert issues == {"19723_1": (2, 0, 1, 1), "19723_1234567": (1, 1, 0, 0)}
    counts = path_partition_columns(lines).collect()
    assert {(r.days_post_epoch, r.LineCount) for r in counts} == {(19723, 2), (19724, 1), (None, 1)}


@pytest.mark.parametrize("fmt", ["orc", "parquet"])
def test_load_then_reload_one_capture(spark, tmp_path, fmt):
    lake = tmp_path / "lake"
    capture(lake, "h", "19723_1", f"c|i|1|{SINCE}", f"c|j|1|{SINCE}")
    capture(lake, "h", "19724_1", f"c|i|2|{SINCE}")
    capture(lake, "other", "19723_1", f"c|i|3|{SINCE}")
    warehouse = Warehouse(spark, str(tmp_path / fmt))
    load_snapshots(warehouse, str(lake))

    def loaded():
        rows = warehouse.read("opCountItem").collect()
        return sorted((r.mongo_hostname, r.days_post_epoch, r.IndexName, r.UseCount) for r in rows)

    first = loaded()
    assert first == [
        ("h", 19723, "i", 1), ("h", 19723, "j", 1), ("h", 19724, "i", 2), ("other", 19723, "i", 3),
    ]
    load_snapshots(warehouse, str(lake), host="h")
    assert loaded() == first
    (lake / "h" / "19723_1" / FILE_NAME).write_text(HEADER + f"c|k|9|{SINCE}\n")
    load_paths(warehouse, [str(lake / "h" / "19723_1")])
    assert loaded() == [("h", 19723, "k", 9), ("h", 19724, "i", 2), ("other", 19723, "i", 3)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_written_captures_read_back(spark, setting, tmp_path, zone):
    capture(tmp_path / "a", "h.1", "19723_36000", f"c|i|7|{SINCE}")
    items = placed_items(read(spark, tmp_path / "a"))
    expected = items.collect()
    setting("spark.sql.session.timeZone", zone)
    again = read_snapshots(spark, write_snapshots(items, str(tmp_path / "b")), "*.csv")
    assert placed_items(again).collect() == expected


def test_only_new_captures_are_loaded(spark, tmp_path):
    lake, progress = tmp_path / "lake", str(tmp_path / "progress")
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))

    def loaded():
        rows = warehouse.read("opCountItem").collect()
        return sorted((r.mongo_hostname, r.days_post_epoch, r.UseCount) for r in rows)

    capture(lake, "h", "19723_1", f"c|i|1|{SINCE}")
    capture(lake, "g", "19723_1", f"c|i|2|{SINCE}")
    load_new_snapshots(warehouse, str(lake), progress, files_per_batch=1)
    assert loaded() == [("g", 19723, 2), ("h", 19723, 1)]
    # A file already loaded is not read again; a new one is.
    (lake / "h" / "19723_1" / FILE_NAME).unlink()
    capture(lake, "h", "19724_1", f"c|i|3|{SINCE}")
    load_new_snapshots(warehouse, str(lake), progress)
    assert loaded() == [("g", 19723, 2), ("h", 19723, 1), ("h", 19724, 3)]


@pytest.mark.parametrize("files_per_batch", [1, 2, 100])
def test_a_capture_is_loaded_whole_whatever_the_batches(spark, tmp_path, files_per_batch):
    lake, progress = tmp_path / "lake", str(tmp_path / "progress")
    streamed = Warehouse(spark, str(tmp_path / "new" / "parquet"))
    batch = Warehouse(spark, str(tmp_path / "all" / "parquet"))

    def add(host: str, snapshot: str, name: str, collection: str) -> None:
        folder = lake / host / snapshot
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(HEADER + f"{collection}|i|1|{SINCE}\n")

    def rows(warehouse):
        return sorted(map(tuple, warehouse.read("opCountItem").collect()))

    for name, collection in (("a.csv", "c1"), ("b.csv", "c2"), ("c.csv", "c3")):
        for snapshot in ("19723_1", "19724_1"):
            add("h", snapshot, name, collection)
    load_new_snapshots(streamed, str(lake), progress, file_name="*.csv", files_per_batch=files_per_batch)
    load_snapshots(batch, str(lake), file_name="*.csv")
    assert rows(streamed) == rows(batch) and len(rows(batch)) == 6
    add("h", "19723_1", "late.csv", "c4")
    load_new_snapshots(streamed, str(lake), progress, file_name="*.csv", files_per_batch=files_per_batch)
    load_snapshots(batch, str(lake), file_name="*.csv")
    assert rows(streamed) == rows(batch) and len(rows(batch)) == 7


def test_every_row_is_stored_or_reported(spark, tmp_path):
    lake = tmp_path / "lake"
    capture(lake, "h", "19723_1", f"c|i|1|{SINCE}", "c|i", f"c|i|2|{SINCE}|more", f"c|i|x|{SINCE}")
    capture(lake, "h", "19723_86400", f"c|i|1|{SINCE}")
    capture(lake, "h", "19723_1234567", f"c|i|1|{SINCE}", f"c|i|2|{SINCE}")
    capture(lake, "h", "19724_1", f"c|i|1|{SINCE}")
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    load_snapshots(warehouse, str(lake))
    issues = {r.file_path.split("/")[-2]: r for r in warehouse.read("loadIssues").collect()}
    assert issues.keys() == {"19723_1", "19723_86400", "19723_1234567"}
    assert (issues["19723_1"].LineCount, issues["19723_1"].CorruptCount) == (4, 3)
    assert issues["19723_86400"].OutOfRangeSecondCount == 1
    assert issues["19723_1234567"].UnplacedCount == 2
    stored = warehouse.read("opCountItem").count()
    assert stored + sum(r.UnplacedCount for r in issues.values()) == 8
    # A later load adds to the report.
    load_paths(warehouse, [str(lake / "h" / "19723_86400")])
    assert warehouse.read("loadIssues").count() == 4


def test_since_is_read_as_the_pattern_reads_it(spark, setting, monkeypatch):
    texts = [
        "2024-01-31 10:20:30 +0000 UTC", "2024-02-29 00:00:00.1 +0000 UTC", "1969-12-31 23:59:59.123456 +0000 UTC",
        "1500-02-28 12:00:00.000 +0000 UTC", "9999-12-31 23:59:59.999999 +0000 UTC",
    ]
    odd = [
        "2024-01-31 10:20:30.123456789 +0000 UTC", "2023-02-29 00:00:00 +0000 UTC", "2024-13-01 00:00:00 +0000 UTC",
        "2024-01-01 24:00:00 +0000 UTC", "2024-01-01 00:60:00 +0000 UTC", "2024-01-01 00:00:60 +0000 UTC",
        "0000-01-01 00:00:00 +0000 UTC", "2024-01-01 00:00:00. +0000 UTC", "2024-01-01 00:00:00 +0100 CET",
        "2024-01-01 00:00:00 +0000 UTC\n", " 2024-01-01 00:00:00 +0000 UTC", "2024-01-01 00:00:00 +0000 +0000 UTC",
        "2024-1-01 00:00:00 +0000 UTC", "n/a", "", None,
    ]
    setting("spark.sql.session.timeZone", "America/New_York")
    rows = spark.createDataFrame([(t,) for t in texts + odd], "t string")
    pattern = F.try_to_timestamp("t", F.lit(snapshots.SINCE_PATTERN))
    found = rows.select("t", F.unix_micros(snapshots.since_timestamp(F.col("t"))), F.unix_micros(pattern)).collect()
    assert [r[:2] for r in found] == [(r[0], r[2]) for r in found]
    # The slow way is left to texts written otherwise.
    monkeypatch.setattr(snapshots, "SINCE_PATTERN", "'never'")
    usual = rows.where(F.col("t").isin(texts)).select(F.unix_micros(snapshots.since_timestamp(F.col("t")))).collect()
    assert all(r[0] is not None for r in usual)
