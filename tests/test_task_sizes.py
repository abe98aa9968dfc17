"""What one task holds stays the same however many rows there are."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyline.operators import history, labels
from tallyline.plans import jobs, report_captures
from tallyline.plans.catalog import Inputs
from tallyline.plans.event_items import op_count_items
from tallyline.sources import publications, reports
from tallyline.sources.warehouse import Warehouse
from tests.conftest import SAMPLE
from tests.test_reports import GOOD, OPS, report


def rows_by_task(df) -> list[int]:
    return [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_lines_of_one_report_are_dealt_to_several_tasks(spark, setting, monkeypatch, tmp_path):
    """However short the pieces, a report gives the same rows, and no task gets most of them."""
    lines = GOOD + [text for n in range(100) for text in (f"db.c{n}:", "{ x }", OPS.format(n))] + ["stray"]
    staged = reports.staged_lines(spark, report(tmp_path, lines), "db")
    setting("spark.sql.shuffle.partitions", "2")
    whole = sorted(map(tuple, reports.numbered_lines(staged).collect()))
    monkeypatch.setattr(reports, "PIECE_BITS", 2)
    monkeypatch.setattr(reports, "TASK_LINES", 16)
    cut = reports.numbered_lines(staged)
    assert sorted(map(tuple, cut.collect())) == whole and len(whole) > 300
    assert max(rows_by_task(cut)) < len(whole) / 3
    assert [r.line for r in reports.report_errors(cut).collect()] == ["stray"]


def test_reports_are_written_by_more_tasks_where_many_lines_are_expected(spark, setting, monkeypatch, tmp_path):
    items = Inputs(spark, SAMPLE).items.where("days_post_epoch = 19730")
    setting("spark.sql.shuffle.partitions", "1")
    monkeypatch.setattr(report_captures, "TASK_LINES", 50)
    lines = report_captures.report_lines(items)
    glob = report_captures.write_reports(lines, str(tmp_path / "lake"), lines.count())
    assert len(spark.read.text(glob).inputFiles()) > 5


def test_captures_of_collections_are_made_after_the_last_shuffle(spark):
    """Starts and uses are shuffled; the grid of indexes and captures is neither joined nor sorted."""
    plan = op_count_items(spark.read.parquet(f"{SAMPLE}/events.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.index("Generate explode(sequence(") < plan.index("Window") < plan.index("Exchange")


def test_series_are_dealt_by_the_number_of_facts(spark, setting, monkeypatch):
    source = Inputs(spark, SAMPLE)
    setting("spark.sql.shuffle.partitions", "2")
    plain = labels.policy_labels_of(source.facts, source.ranges)
    monkeypatch.setattr(history, "SERIES_ROWS", 100)
    dealt = labels.policy_labels_of(source.facts, source.ranges, expected=source.expected)
    tasks = 1 + source.items.count() // 2 // 100
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(mongo_hostname#\d+, CollectionName#\d+, {tasks}\)", plan)
    assert len(rows_by_task(dealt)) > 10
    assert sorted(map(tuple, dealt.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_labels_of_a_host_are_written_in_pieces_where_there_are_many(spark, setting, monkeypatch, tmp_path):
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    warehouse.write("opCountItem", Inputs(spark, SAMPLE).items.filter("days_post_epoch < 19727"))
    found = []
    for facts_a_piece in (1 << 20, 20):
        monkeypatch.setattr(jobs, "PIECE_FACTS", facts_a_piece)
        labelled = jobs.run_all(warehouse)
        found.append((len(labelled.inputFiles()), sorted(map(tuple, labelled.collect()), key=repr)))
    assert found[0][1] == found[1][1] and found[0][0] < found[1][0]
    assert publications.number(warehouse) == 2
