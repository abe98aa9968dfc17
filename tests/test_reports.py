"""Raw reports: cleaning, grammar, errors, and files cut into many blocks."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest

from tallyline.plans.report_captures import LINE_ORDER, report_lines, write_reports
from tallyline.sources.reports import (
    FILE_NAME,
    clean_lines,
    load_reports,
    numbered_lines,
    parse_reports,
    report_errors,
    report_items,
    staged_lines,
)
from tallyline.sources.snapshots import lake_glob
from tallyline.sources.warehouse import Warehouse

OPS = "ops: {}, since: 2024-01-01 00:00:00.000 +0000 UTC"
GOOD = [
    "2024-01-02 R simagix/keyhole v1",
    "index report",
    "",
    "db.first:",
    '   { "_id" : 1 }  *',
    "     host1: " + OPS.format(5),
    "a counter is larger than the max int32 value",
    '   { "a" : 1, "b" : { "c" : -1 } }',
    "     host1: " + OPS.format(0),
    "db.second.part:",
    '{ "_id" : 1 }',
    OPS.format(12),
    "2024-01-02 I GetIndexes ends",
]


def report(root: Path, lines: list[str], host: str = "h", snapshot: str = "19723_1") -> str:
    folder = root / host / snapshot
    folder.mkdir(parents=True)
    (folder / FILE_NAME).write_text("".join(line + "\n" for line in lines))
    return lake_glob(str(root))


def numbered(spark, paths: str):
    return numbered_lines(staged_lines(spark, paths, "db"))


def items_of(df):
    return sorted((r.CollectionName, r.IndexName, r.UseCount) for r in df.collect())


def errors_of(df):
    return [
        (r.line_no, r.line, r.expected) for r in report_errors(df).orderBy("line_no").collect()
    ]


def test_clean(spark):
    cases = {
        'x { "a" : 1 } y': '{ "a" : 1 }',
        "{}": "{}",
        "{ a": "{ a",
        "a }b": "a }",
        "a } b } c": "a } b }",
        "plain": "plain",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, "", "R simagix/keyhole"]], "line string")
    assert [r.line for r in clean_lines(df).collect()] == list(cases.values())


def test_parse(spark, tmp_path):
    paths = report(tmp_path, GOOD)
    assert items_of(parse_reports(spark, paths, "db")) == [
        ("db.first", '{ "_id" : 1 }', 5),
        ("db.first", '{ "a" : 1, "b" : { "c" : -1 } }', 0),
        ("db.second.part", '{ "_id" : 1 }', 12),
    ]
    assert errors_of(numbered(spark, paths)) == []


def test_first_line_is_read_past(spark, tmp_path):
    """Without a line of preamble the first collection line is lost, and so is its index."""
    df = numbered(spark, report(tmp_path, GOOD[3:6] + GOOD[9:12]))
    assert items_of(report_items(df)) == [("db.second.part", '{ "_id" : 1 }', 12)]
    assert errors_of(df)[0] == (1, '{ "_id" : 1 }', "collection")


@pytest.mark.parametrize(
    "lines,items,errors",
    [
        (["db.a:", "stray", "{ x }", OPS.format(1)], [("db.a", "{ x }", 1)], [(2, "stray", "index")]),
        (["db.a:", "{ x }", "{ y }", OPS.format(1)], [("db.a", "{ y }", 1)], [(3, "{ y }", "opcount")]),
        (["db.a:", OPS.format(1)], [], [(2, OPS.format(1), "index")]),
        (["db.a:", "db.b:", "{ x }", OPS.format(1)], [("db.b", "{ x }", 1)], [(2, "db.b:", "index")]),
        (
            ["db.a:", "{ x }", OPS.format(1), OPS.format(2)],
            [("db.a", "{ x }", 1)],
            [(4, OPS.format(2), "index or collection")],
        ),
        (["other.a:", "db.a:"], [], [(1, "other.a:", "collection")]),
        (["db.a:", "{ x }", "host: ops: none"], [], [(3, "host: ops: none", "opcount")]),
    ],
)
def test_errors_are_listed_and_the_rest_is_kept(spark, tmp_path, lines, items, errors):
    df = numbered(spark, report(tmp_path, ["preamble", *lines]))
    assert items_of(report_items(df)) == items
    assert errors_of(df) == errors


def machine(lines: list[str]) -> tuple[list, list]:
    """The line grammar as a sequential reader of cleaned lines, resuming after errors."""
    items, errors, collection, prior, index = [], [], None, None, None
    for number, line in enumerate(lines):
        if number == 0:
            continue
        header = re.fullmatch(r"(db.*):", line)
        ops = re.search(r"ops: ([0-9]+), since: (.* UTC)", line)
        kind = (
            "collection" if header else "index" if re.fullmatch(r"\{.*\}", line)
            else "opcount" if ops else "other"
        )
        if header:
            collection = header.group(1)
        expected = {"collection": "index", "index": "opcount"}.get(prior) or (
            "index or collection" if collection else "collection"
        )
        if kind not in expected.split(" or "):
            errors.append((number, line, expected))
        if kind == "opcount" and prior == "index" and collection:
            items.append((collection, index, int(ops.group(1))))
        if kind == "index":
            index = line
        prior = kind
    return sorted(items), errors


@pytest.mark.parametrize("block_bytes", [60, 400])
def test_blocks_do_not_matter(spark, setting, tmp_path, block_bytes):
    """A file cut into blocks of a few lines gives what a sequential reader gives."""
    normal = spark.conf.get("spark.sql.files.maxPartitionBytes")
    pick = random.Random(block_bytes)
    choices = ["db.a:", "db.bb:", "{ x }", "{ yy }", OPS.format(3), OPS.format(44), "stray", ""]
    weights = [1, 1, 4, 4, 4, 4, 1, 1]
    paths = ""
    expected = {}
    for number in range(3):
        lines = pick.choices(choices, weights, k=40)
        paths = report(tmp_path, lines, snapshot=f"19723_{number}")
        expected[number] = machine([line for line in lines if line])
    setting("spark.sql.files.openCostInBytes", "0")
    setting("spark.sql.files.maxPartitionBytes", str(block_bytes))
    staged = staged_lines(spark, paths, "db")
    setting("spark.sql.files.maxPartitionBytes", normal)
    assert staged.select("file_path", "block").distinct().count() > 8
    df = numbered_lines(staged)
    items, errors = report_items(df).collect(), report_errors(df).orderBy("line_no").collect()
    for number, (expected_items, expected_errors) in expected.items():
        assert expected_items == sorted(
            (r.CollectionName, r.IndexName, r.UseCount) for r in items if r.seconds_of_day == number
        )
        assert expected_errors == [
            (r.line_no, r.line, r.expected) for r in errors if r.seconds_of_day == number
        ]


def test_one_report_in_several_files(spark, setting, tmp_path):
    """However many files a report is cut into: the same numbers, rows and errors."""
    items = spark.createDataFrame(
        [("h", 19723, 1 + n % 2, f"db.c{n // 4}", "{ x%d }" % n, n, None) for n in range(80)],
        "mongo_hostname string, days_post_epoch int, seconds_of_day int, CollectionName string, "
        "IndexName string, UseCount bigint, Since timestamp",
    ).selectExpr("* except (Since)", "timestamp_seconds(UseCount) AS Since")
    lines = report_lines(items).filter("not (line like '%ops: 7%')")
    setting("spark.sql.adaptive.enabled", "false")
    found = []
    for files in (1, 7):
        setting("spark.sql.shuffle.partitions", str(files))
        paths = write_reports(lines, str(tmp_path / str(files)))
        assert len(list((tmp_path / str(files)).glob("*/*1/*.txt"))) == files // 2 + 1
        df = numbered_lines(staged_lines(spark, paths, "db", "*.txt"))
        found.append((
            sorted(map(tuple, df.select("mongo_hostname", "days_post_epoch", "seconds_of_day", "line_no", "line", "collection").collect())),
            sorted(map(tuple, report_items(df).select(items.columns).collect())),
            sorted(map(tuple, report_errors(df).drop("file_path").collect())),
        ))
    assert found[0] == found[1]
    rows, parsed, errors = found[0]
    assert parsed == sorted(tuple(r) for r in items.filter("not cast(UseCount as string) like '7%'").collect())
    assert len(errors) > 5 and LINE_ORDER[0] == "mongo_hostname"
    # Every capture has one line 0 and no number twice.
    places = [row[:4] for row in rows]
    assert len(set(places)) == len(places) and sum(row[3] == 0 for row in rows) == 2


def test_every_counter_line_is_stored_or_reported(spark, tmp_path):
    """Two reports, one with a stray counter line, the other where no capture should be."""
    report(tmp_path / "lake", ["preamble", "db.a:", "{ x }", OPS.format(1), OPS.format(2)])
    report(tmp_path / "lake", ["preamble", "db.b:", "{ y }", OPS.format(3)], snapshot="1_1")
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    load_reports(warehouse, lake_glob(str(tmp_path / "lake")), "db")
    assert [r.UseCount for r in warehouse.read("opCountItem").collect()] == [1]
    (issue,) = warehouse.read("loadIssues").collect()
    assert (issue.LineCount, issue.UnplacedCount) == (1, 1) and "/1_1/" in issue.file_path
    (error,) = warehouse.read("loadErrors").collect()
    assert (error.mongo_hostname, error.line_no, error.line) == ("h", 4, OPS.format(2))
