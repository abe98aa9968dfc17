"""Report texts on hand-made policy labels."""

from __future__ import annotations

from random import Random

import pytest

from tallyline.operators import legacy, sankey
from tallyline.operators.facts import distinct_snapshots
from tallyline.operators.labels import discrete_history, with_policy_status
from tallyline.operators.timeline import partition_ranges
from tallyline.sources.scratch import stored

STATES = {
    "a": ["NotLoaded", "Active", "Idle", "Restorable", "Active", "Deleted", "Deleted"],
    "b": ["NotLoaded", "Active", "Active", "Idle", "Inactive", "Inactive", "Deleted"],
    "c": ["NotCreated", "NotCreated", "Active", "ERROR", "Active", "Idle", "Idle"],
}


@pytest.fixture
def labels(spark):
    rows = [
        ("h", name, rank, state)
        for name, states in STATES.items()
        for rank, state in enumerate(states, 1)
    ]
    return spark.createDataFrame(
        rows, "mongo_hostname string, CollectionName string, PartitionRank int, "
        "ActivityPolicyStatus string",
    )


def texts(df):
    return [row.sankey_row for row in df.collect()]


def test_rows(labels):
    rows = texts(sankey.sankey_rows(sankey.transitions(labels)))
    assert rows[:3] == [
        "NotCreated1 [1] NotCreated2", "NotLoaded1 [2] Active2", "Active2 [1] Active3",
    ]
    assert len(rows) == 17


def test_report(labels):
    assert texts(sankey.sankey_report(sankey.transitions(labels))) == [
        "NL1 [2] A2",
        "A2 [1] A3", "A2 [1] I3", "NC2 [1] A3",
        "A3 [1] ERROR4", "A3 [1] I4", "I3 [1] R4",
        "ERROR4 [1] A5", "I4 [1] Inactive", "R4 [1] A5",
        "A5 [1] Deleted", "A5 [1] I6",
        "I6 [1] I7",
    ]


def test_ordered_report(labels):
    rows = [(r.ReportGroup, r.sankey_row) for r in sankey.sankey_report_ordered(sankey.transitions(labels)).collect()]
    assert rows == [
        (1, "NotCreated1 [1] NotCreated2"), (1, "NotLoaded1 [2] Active2"),
        (1, "NotCreated2 [1] Active3"),
        (2, "Active5 [1] Deleted6"),
        (3, "Active2 [1] Active3"),
        (4, "Restorable4 [1] Active5"),
        (6, "Active2 [1] Idle3"), (6, "Active3 [1] Idle4"), (6, "Active5 [1] Idle6"),
        (7, "Idle3 [1] Restorable4"),
        (9, "Idle6 [1] Idle7"),
        (10, "Idle4 [1] Inactive5"),
    ]


def test_change_navigation(spark):
    statuses = ["x", "x", "y", "y", "x"]
    df = spark.createDataFrame(
        [("h", "c", rank, status) for rank, status in enumerate(statuses, 1)],
        "mongo_hostname string, CollectionName string, PartitionRank int, "
        "CollectionUseStatus string",
    )
    rows = legacy.change_navigation(df).orderBy("PartitionRank").collect()
    assert [r.ChangedAtRank for r in rows] == [1, None, 3, None, 5]
    assert [r.ChangedUseStatusTo for r in rows] == ["x", None, "y", None, "x"]
    assert [r.PriorChangeRank for r in rows] == [None, 1, 1, 3, 3]
    assert [r.PriorChangeStatus for r in rows] == [None, "x", "x", "y", "y"]
    assert [r.PriorChangeRankTwo for r in rows] == [None, None, 1, 2, 3]
    assert [r.PriorChangeStatusTwo for r in rows] == [None, None, "x", "x", "y"]


FACTS = "mongo_hostname string, days_post_epoch int, seconds_of_day int, CollectionName string, UseCount long, ActiveIndexCount long, TotalIndexCount long"


@pytest.mark.parametrize("rules", ["current", "v1"])
@pytest.mark.parametrize("n", [1, 3])
def test_transitions_of_facts_are_those_of_the_labels(spark, n, rules):
    """Random presence and counters, with gaps at either end, resets, nulls and a missing name."""
    random = Random(5)
    rows = []
    for host, snapshots in (("h", 9), ("g", 1), ("k", 2)):
        for k in range(60):
            name, count = None if k == 7 else f"c{k}", random.choice([0, 0, 3])
            rate = random.choice([0.2, 0.6, 1.0])
            for day in range(snapshots):
                count = random.choice([count, count, count + 2, 0 if k % 9 == 0 else count])
                if random.random() < rate:
                    rows.append((host, day, 5, name, None if random.random() < 0.03 else count, 1, 1))
        rows += [(host, day, 5, "always", 1, 1, 1) for day in range(snapshots)]
    facts = spark.createDataFrame(rows, FACTS)
    ranges = stored(partition_ranges(distinct_snapshots(facts)), "ranges")
    wanted = sankey.transitions(with_policy_status(discrete_history(facts, ranges, rules), n, rules))
    got = sankey.transitions_of_facts(facts, ranges, n, rules)
    columns = ("mongo_hostname", "PartitionRank", "PriorRank", "Before", "After", "EdgeCount")
    assert sorted(got.select(*columns).collect()) == sorted(wanted.select(*columns).collect())
    assert {"NotCreated", "Deleted"} < {r.Before for r in got.collect()}
