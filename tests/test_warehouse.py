"""Roots, formats and partition-wise overwriting."""

from __future__ import annotations

import tempfile
from types import SimpleNamespace

import pytest

from tallyline.operators import facts as fact_ops
from tallyline.operators.sankey import sankey_rows, transitions, write_report
from tallyline.plans import jobs
from tallyline.plans.event_items import op_count_items
from tallyline.schema import TABLES
from tallyline.sources import scratch
from tallyline.sources.warehouse import Warehouse, infer_format, validate_root
from tests.conftest import SAMPLE


@pytest.mark.parametrize("root", ["/lake/orc", "s3a://b/x", "s3://b", "hdfs://n/x", "gs://b", "abfs://c", "file:///x"])
def test_valid_roots(root):
    assert validate_root(root) == root


@pytest.mark.parametrize("root", ["", "lake/orc", "http://x/orc", "s3a:/x", "./x"])
def test_invalid_roots(root):
    with pytest.raises(ValueError):
        validate_root(root)


def test_formats():
    assert infer_format("/lake/orc/x") == "orc"
    assert infer_format("s3a://bucket/parquet") == "parquet"
    assert infer_format("/lake/orc", "parquet") == "parquet"
    for root in ("/lake", "/orc/parquet", "/lake/orcs"):
        with pytest.raises(ValueError):
            infer_format(root)
    with pytest.raises(ValueError):
        infer_format("/lake", "csv")


def test_overwrite_by_partition(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path), "parquet")
    schema = TABLES["collectionOpsAgg"].schema

    def write(*rows):
        warehouse.write("collectionOpsAgg", spark.createDataFrame(rows, schema))

    write(("123", 1, 1, "c", 5, 1, 1), ("0456", 1, 1, "c", 6, 1, 1), ("0456", 1, 2, "c", 7, 1, 1))
    write(("0456", 1, 2, "d", 8, 1, 1))
    rows = sorted(tuple(r) for r in warehouse.read("collectionOpsAgg").collect())
    assert rows == [
        ("0456", 1, 1, "c", 6, 1, 1), ("0456", 1, 2, "d", 8, 1, 1), ("123", 1, 1, "c", 5, 1, 1),
    ]
    assert warehouse.read("collectionOpsAgg").schema == schema


def test_all_jobs_and_both_formats(spark, tmp_path):
    results = {}
    for fmt in ("orc", "parquet"):
        warehouse = Warehouse(spark, str(tmp_path / fmt))
        events = spark.read.parquet(f"{SAMPLE}/events.parquet")
        items = op_count_items(events).filter("days_post_epoch < 19731 AND mongo_hostname > 'mongo01'")
        warehouse.write("opCountItem", items)
        policy = jobs.run_all(warehouse)
        jobs.label_legacy(warehouse)
        results[fmt] = {
            name: sorted(map(repr, warehouse.read(name).collect()))
            for name in TABLES
            if not TABLES[name].log
        }
        report = tmp_path / fmt / "report"
        jobs.report_transitions(warehouse, str(report))
        edges = sankey_rows(transitions(policy))
        write_report(edges, str(tmp_path / fmt / "rows"))
        texts = {
            host.name: [
                line
                for part in sorted(host.glob("part-*"))
                for line in part.read_text().splitlines()
            ]
            for host in (tmp_path / fmt / "rows").glob("mongo_hostname=*")
        }
        expected: dict[str, list[str]] = {}
        for row in edges.collect():
            expected.setdefault(f"mongo_hostname={row.mongo_hostname}", []).append(row.sankey_row)
        assert texts == expected
    assert results["orc"] == results["parquet"]
    assert len(results["orc"]["indexOpsAgg"]) > 0


def test_facts_written_in_one_run(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path), "parquet")
    items = op_count_items(spark.read.parquet(f"{SAMPLE}/events.parquet"))
    items = items.filter("days_post_epoch >= 19746")
    facts, index = fact_ops.recompute_facts(items, warehouse)
    assert sorted(index.collect()) == sorted(fact_ops.index_facts(items, facts).collect())


def test_scratch_is_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = scratch.scratch_folder(spark, "x")
    assert folder.startswith(f"{named or tempfile.gettempdir()}/tallyline-x-")
    assert folder != scratch.scratch_folder(spark, "x")
    assert sorted(r.id for r in scratch.stored(spark.range(3), "y").collect()) == [0, 1, 2]


def test_no_machine_local_scratch_on_a_cluster():
    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(master="yarn"),
    )
    with pytest.raises(RuntimeError):
        scratch.shared_root(cluster)


def test_scratch_folders_are_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "shared_root", lambda _: str(tmp_path))
    kept = scratch.stored(spark.range(3), "kept")
    with scratch.temporary(spark):
        assert scratch.stored(spark.range(2), "inside").count() == 2
        assert len(list(tmp_path.glob("tallyline-*"))) == 2
    assert len(list(tmp_path.glob("tallyline-*"))) == 1 and kept.count() == 3
    with pytest.raises(ValueError), scratch.temporary(spark):
        scratch.stored(spark.range(2), "failed")
        raise ValueError
    assert len(list(tmp_path.glob("tallyline-*"))) == 1


def test_jobs_leave_no_scratch_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "shared_root", lambda _: str(tmp_path / "scratch"))
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    events = spark.read.parquet(f"{SAMPLE}/events.parquet").filter("user_id < 4")
    warehouse.write("opCountItem", op_count_items(events))
    jobs.run_all(warehouse)
    jobs.label_legacy(warehouse)
    assert list((tmp_path / "scratch").glob("*")) == []


def test_events_of_any_days_are_kept(spark):
    """Uses at the second at which this host is captured every day."""
    rows = [(1, f"2024-03-{d:02d} 10:00:00", 6, "click", 90.0, '{"k": 60}') for d in range(1, 31)]
    rows += [(2, f"2024-04-{d:02d} 10:00:00", 6, "click", 90.0, '{"k": 60}') for d in range(1, 11)]
    events = spark.createDataFrame(
        rows, "event_id long, ts string, user_id long, event_type string, value double, props string"
    )
    items = op_count_items(events).filter("IndexName = 'k_hi'")
    last = items.orderBy("days_post_epoch").collect()[-1]
    assert items.select("days_post_epoch").distinct().count() == 41 and last.UseCount == 40
