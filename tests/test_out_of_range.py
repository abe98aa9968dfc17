"""Seconds that no day has: snapshots are ordered by day first, then by second."""

from __future__ import annotations

from tallyline.operators.facts import distinct_snapshots, known_collections
from tallyline.operators.labels import discrete_labels
from tallyline.operators.timeline import partition_ranges

FACTS = (
    "mongo_hostname string, days_post_epoch int, seconds_of_day int, CollectionName string, "
    "UseCount bigint, ActiveIndexCount bigint, TotalIndexCount bigint"
)


def test_order_is_by_day_then_second(spark):
    """(100, 95000) is later on the clock than (101, 0), but it is the earlier snapshot."""
    rows = [("h", 100, 95_000, "gone", 3, 1, 1), ("h", 100, 95_000, "both", 1, 1, 1), ("h", 101, 0, "both", 2, 1, 1)]
    facts = spark.createDataFrame(rows, FACTS)
    ranges = partition_ranges(distinct_snapshots(facts))
    ranks = {(r.days_post_epoch, r.seconds_of_day): r.partition_rank for r in ranges.collect()}
    assert ranks == {(100, 95_000): 1, (101, 0): 2}
    labels = {
        (r.CollectionName, r.PartitionRank): r.CollectionUseStatus
        for r in discrete_labels(facts, ranges).collect()
    }
    # There at the first snapshot and purged since: removed, not "not yet created".
    assert labels["gone", 2] == "Removed" and len(labels) == 4
    known = {r.CollectionName: tuple(r) for r in known_collections(facts).collect()}
    assert 101 * 86_400 in known["both"] and 100 * 86_400 + 95_000 in known["gone"]
