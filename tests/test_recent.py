"""Loading new hosts and days only."""

from __future__ import annotations

from fnmatch import fnmatchcase

import pytest

from tallyline.schema import OP_COUNT_ITEM
from tallyline.sources import recent
from tallyline.sources.recent import from_day, load_recent, recent_directories
from tallyline.sources.snapshots import load_snapshots
from tallyline.sources.warehouse import Warehouse
from tests.test_incremental import capture


@pytest.mark.parametrize("day", [0, 9, 19739, 19999, 89999, 99999])
def test_pattern_of_days(day):
    patterns = from_day(day)[1:-1].split(",")
    for other in {0, 5, 9, 10, 99, 1000, 19738, 19739, 19740, 19999, 20000, 29999, 89999, 90000, 99998, 99999}:
        assert any(fnmatchcase(f"{other:05d}", p) for p in patterns) == (other >= day)


def test_only_new_hosts_and_days_are_listed(spark, tmp_path, monkeypatch):
    lake = tmp_path / "lake"
    for host in ("h1", "h.2"):
        for day in (19723, 19724, 19999):
            capture(lake, host, f"{day}_5", ("c", day))
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    load_snapshots(warehouse, str(lake))

    capture(lake, "h1", "19999_5", ("c", 7))  # changed on the last day
    capture(lake, "h1", "19999_9", ("c", 8))
    capture(lake, "h.2", "20000_5", ("c", 9))
    capture(lake, "h3", "19000_1", ("c", 1), ("d", 2))
    (lake / "h.2" / "19999_5" / recent.FILE_NAME).unlink()
    names = sorted("/".join(d.split("/")[-2:]) for d in recent_directories(warehouse, str(lake)))
    assert names == ["h.2/19999_5", "h.2/20000_5", "h1/19999_5", "h1/19999_9", "h3/19000_1"]

    loads = []
    load = recent.load_paths
    monkeypatch.setattr(recent, "load_paths", lambda w, paths, name: loads.append(len(paths)) or load(w, paths, name))
    assert load_recent(warehouse, str(lake), per_load=3) == 5 and loads == [3, 2]
    fresh = Warehouse(spark, str(tmp_path / "anew" / "parquet"))
    load_snapshots(fresh, str(lake))
    items = [sorted(map(repr, w.read(OP_COUNT_ITEM.name).collect())) for w in (warehouse, fresh)]
    assert items[0] == items[1] and len(items[0]) == 9
