"""Reloading, removing and publishing: what is touched, what follows, and what stays as it was."""

from __future__ import annotations

from pathlib import Path

import pytest

from tallyline.plans import jobs
from tallyline.plans.event_items import op_count_items
from tallyline.schema import COLLECTION_DISCRETE_LABELS, COLLECTION_POLICY_LABELS, OP_COUNT_ITEM, TABLES
from tallyline.sources import manifest, publications, reports, snapshots
from tallyline.sources.snapshots import FILE_NAME, load_paths, load_snapshots, remove_captures
from tallyline.sources.warehouse import Warehouse
from tests.conftest import SAMPLE

HEADER = "CollectionName|IndexName|UseCount|Since\n"
SINCE = "2024-01-01 10:00:00 +0000 UTC"
DERIVED = ("collectionOpsAgg", "indexOpsAgg", "partitionRanges", "collectionDiscreteLabels", "collectionActivityPolicyLabels")


def capture(lake: Path, host: str, snapshot: str, *counts: tuple[str, int]) -> Path:
    folder = lake / host / snapshot
    folder.mkdir(parents=True, exist_ok=True)
    (folder / FILE_NAME).write_text(HEADER + "".join(f"{c}|i|{n}|{SINCE}\n" for c, n in counts))
    return folder


def small_lake(lake: Path) -> None:
    for host, first in (("h1", 0), ("h2", 3), ("h3", 1)):
        for day in range(5):
            counts = [(f"c{k}", first + day * k) for k in range(3)] + ([("late", day)] if day > 2 else [])
            capture(lake, host, f"{19723 + day}_36000", *counts)


def rows(warehouse, name):
    return sorted(map(repr, warehouse.read(name).collect()))


def files(root: Path, host: str) -> dict:
    return {f: f.stat().st_mtime_ns for f in root.rglob(f"mongo_hostname={host}/**/part-*")}


def assert_as_anew(spark, warehouse, lake, root):
    """Every derived table is what a fresh load and a full run of the same captures give."""
    fresh = Warehouse(spark, str(root), "parquet")
    load_snapshots(fresh, str(lake))
    jobs.run_all(fresh)
    for name in (OP_COUNT_ITEM.name, *DERIVED):
        assert rows(warehouse, name) == rows(fresh, name), name


def test_emptied_capture_leaves_no_row_anywhere(spark, tmp_path):
    lake, root = tmp_path / "lake", tmp_path / "warehouse"
    small_lake(lake)
    warehouse = Warehouse(spark, str(root), "parquet")
    load_snapshots(warehouse, str(lake))
    jobs.run_changed(warehouse)
    before = {host: files(root, host) for host in ("h1", "h3")}

    load_paths(warehouse, [str(capture(lake, "h2", "19725_36000"))])
    assert warehouse.read(OP_COUNT_ITEM.name).where("mongo_hostname = 'h2' AND days_post_epoch = 19725").count() == 0
    jobs.run_changed(warehouse)
    assert {host: files(root, host) for host in ("h1", "h3")} == before
    for name in DERIVED:
        assert warehouse.read(name).where("mongo_hostname = 'h2' AND days_post_epoch = 19725").count() == 0
    assert_as_anew(spark, warehouse, lake, tmp_path / "anew")


def test_changed_new_and_vanished_captures(spark, tmp_path):
    lake, root = tmp_path / "lake", tmp_path / "warehouse"
    small_lake(lake)
    warehouse = Warehouse(spark, str(root), "parquet")
    load_snapshots(warehouse, str(lake))
    jobs.run_changed(warehouse)
    untouched = files(root, "h1")
    # Other counts, a new capture, a new host, a directory without its file, and a host without any row.
    touched = [capture(lake, "h2", "19724_36000", ("c1", 90)), capture(lake, "h2", "19728_5", ("c1", 91)), capture(lake, "h9", "19723_1", ("z", 0))]
    (lake / "h2" / "19726_36000" / FILE_NAME).unlink()
    touched += [lake / "h2" / "19726_36000"]
    touched += [capture(lake, "h3", f"{19723 + day}_36000") for day in range(5)]
    load_paths(warehouse, [str(p) for p in touched])
    policy = jobs.run_changed(warehouse)
    assert files(root, "h1") == untouched
    assert {r.mongo_hostname for r in policy.select("mongo_hostname").distinct().collect()} == {"h1", "h2"}
    assert_as_anew(spark, warehouse, lake, tmp_path / "anew")

    publication = publications.number(warehouse)
    jobs.run_changed(warehouse)
    assert publications.number(warehouse) == publication  # nothing was loaded, nothing is made
    jobs.run_changed(warehouse, n_inactivity=2)  # another policy concerns every host
    full = Warehouse(spark, str(tmp_path / "anew"), "parquet")
    jobs.run_all(full, n_inactivity=2)
    assert rows(warehouse, COLLECTION_POLICY_LABELS.name) == rows(full, COLLECTION_POLICY_LABELS.name)


def test_all_hosts_gone(spark, tmp_path):
    lake = tmp_path / "lake"
    capture(lake, "h", "19723_1", ("c", 1))
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    load_snapshots(warehouse, str(lake))
    assert jobs.run_changed(warehouse).count() == 1
    remove_captures(warehouse, warehouse.read(OP_COUNT_ITEM.name))
    assert jobs.run_changed(warehouse).count() == 0
    assert all(rows(warehouse, name) == [] for name in ("collectionOpsAgg", "partitionRanges", "collectionDiscreteLabels"))
    load_snapshots(warehouse, str(lake))
    assert jobs.run_changed(warehouse).count() == 1


def test_emptied_report(spark, tmp_path):
    folder = tmp_path / "lake" / "h" / "19723_1"
    folder.mkdir(parents=True)
    report = folder / reports.FILE_NAME
    text = 'opening\nloadtest.c:\n{ "a": 1 }\nnode: ops: 3, since: 2024-01-01 10:00:00 +0000 UTC\n'
    report.write_text(text)
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    reports.load_reports(warehouse, str(tmp_path / "lake" / "*" / "*_*"))
    assert warehouse.read(OP_COUNT_ITEM.name).count() == 1 and warehouse.read("loadErrors").count() == 0
    for emptied in ("opening\n", ""):
        report.write_text(text)
        reports.load_reports(warehouse, str(folder))
        assert warehouse.read(OP_COUNT_ITEM.name).count() == 1
        report.write_text(emptied)
        reports.load_reports(warehouse, str(folder))
        assert warehouse.read(OP_COUNT_ITEM.name).count() == 0


def test_a_failed_load_is_known(spark, tmp_path, monkeypatch):
    """Touched captures are noted before anything is changed, so the next run looks at them again."""
    lake = tmp_path / "lake"
    small_lake(lake)
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    load_snapshots(warehouse, str(lake))
    jobs.run_changed(warehouse)
    folder = capture(lake, "h2", "19724_36000", ("c1", 90))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(Warehouse, "drop", fail)
        load_paths(warehouse, [str(folder)])
    assert [tuple(r)[:3] for r in manifest.touched_since(warehouse, 1).collect()] == [("h2", 19724, 36000)]
    jobs.run_changed(warehouse)
    assert_as_anew(spark, warehouse, lake, tmp_path / "anew" / "parquet")


@pytest.mark.parametrize("step", ["second table", "publication"])
def test_failure_while_labelling_leaves_a_consistent_pair(spark, tmp_path, monkeypatch, step):
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    items = op_count_items(spark.read.parquet(f"{SAMPLE}/events.parquet")).filter("days_post_epoch < 19728")
    warehouse.write(OP_COUNT_ITEM.name, items)
    jobs.run_all(warehouse)
    pair = [COLLECTION_POLICY_LABELS.name, COLLECTION_DISCRETE_LABELS.name]
    before = [rows(warehouse, name) for name in pair]

    warehouse.write(OP_COUNT_ITEM.name, items.withColumn("UseCount", items.UseCount * 0))
    write = publications.Generation.write

    def fail(self, name, *args):
        if step == "publication" or name == COLLECTION_DISCRETE_LABELS.name:
            raise OSError("lost")
        return write(self, name, *args)

    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(publications.Generation, "publish" if step == "publication" else "write", lambda self, *a: fail(self, *(a or ("",))))
        jobs.run_all(warehouse)
    assert [rows(warehouse, name) for name in pair] == before
    columns = TABLES[pair[1]].schema.names
    assert sorted(map(repr, warehouse.read(pair[0]).select(*columns).collect())) == before[1]
    jobs.run_all(warehouse)
    assert [rows(warehouse, name) for name in pair] != before

    folders = lambda: {p.name for p in tmp_path.glob(f"parquet/{pair[0]}/Generation=*")}
    now = [rows(warehouse, name) for name in pair]
    assert len(folders()) == 3
    publications.clean_up(warehouse, keep=1)
    assert len(folders()) == 1 and [rows(warehouse, name) for name in pair] == now


def test_more_hosts_than_a_plan_lists(spark, tmp_path, monkeypatch):
    lake = tmp_path / "lake"
    small_lake(lake)
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    load_snapshots(warehouse, str(lake))
    jobs.run_changed(warehouse)
    listed = {name: rows(warehouse, name) for name in DERIVED}
    monkeypatch.setattr(publications, "LISTED", 1)
    monkeypatch.setattr(jobs, "LISTED", 1)
    load_snapshots(warehouse, str(lake))
    jobs.run_changed(warehouse)
    assert {name: rows(warehouse, name) for name in DERIVED} == listed


def test_lines_are_looked_at_again_only_for_issues(spark, tmp_path, monkeypatch):
    lake = tmp_path / "lake"
    folder = capture(lake, "h", "19723_1", ("c", 1))
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    asked = []
    found = snapshots.load_issues
    monkeypatch.setattr(snapshots, "load_issues", lambda lines: asked.append(1) or found(lines))
    load_paths(warehouse, [str(folder)])
    assert not asked and warehouse.read("loadIssues").collect() == []
    capture(lake, "h", "19724_1", ("c", 1), ("c|more", 1))
    load_snapshots(warehouse, str(lake))
    assert asked and [r.CorruptCount for r in warehouse.read("loadIssues").collect()] == [1]


def scanned_rows(df) -> int:
    """Rows that the file scan of a plan gave, after the plan has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("fmt", ["orc", "parquet"])
def test_look_up_skips_what_does_not_hold_the_name(spark, tmp_path, fmt):
    """Names between the least and the greatest of a file are told apart by Bloom filters."""
    name = COLLECTION_POLICY_LABELS.name
    warehouse = Warehouse(spark, str(tmp_path / fmt))
    labels = spark.range(2000).selectExpr(
        "'h' AS mongo_hostname", "19723 AS days_post_epoch", "1 AS seconds_of_day", "1 AS PartitionRank",
        "concat('c', lpad(id * 2, 6, '0')) AS CollectionName", "id AS UseCount", "'Current' AS CollectionUseStatus",
        "'Active' AS ActivityPolicyStatus",
    )
    warehouse.write(name, labels)
    found = warehouse.read(name).where("CollectionName = 'c000100'")
    assert scanned_rows(found) > 0 and found.count() == 1
    assert scanned_rows(warehouse.read(name).where("CollectionName = 'c000101'")) == 0


def test_queries_of_emptied_captures_fill_no_table_beyond_their_own(spark, monkeypatch):
    from tallyline.plans import prepared
    from tallyline.plans.catalog import registered
    from tests.conftest import SAMPLE

    monkeypatch.setattr(prepared, "_prepared", {})
    whole = {q: registered()[q] for q in ("reload_emptied_snapshot", "facts_of_changed_captures")}
    monkeypatch.setattr(prepared.jobs, "label_all", None)
    alone = {q: sorted(map(str, query(spark, SAMPLE).collect())) for q, query in whole.items()}
    monkeypatch.undo()
    monkeypatch.setattr(prepared, "_prepared", {})
    registered()["labels_of_changed_hosts"](spark, SAMPLE)
    assert alone == {q: sorted(map(str, query(spark, SAMPLE).collect())) for q, query in whole.items()}
