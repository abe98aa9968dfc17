"""The dense history: gaps, returns, resets, unused and unreadable counters."""

from __future__ import annotations

from tallyline.operators import facts as fact_ops
from tallyline.operators import history, labels, sankey, timeline

ITEM = (
    "CollectionName string, IndexName string, UseCount bigint, mongo_hostname string, "
    "days_post_epoch int, seconds_of_day int"
)


def tables(spark, series: dict[str, list[int | None | str]], host: str = "h"):
    """Counters per collection, one entry per snapshot; '-' where the collection is absent."""
    rows = [
        (name, "i", use, host, 20000 + day, 3600)
        for name, uses in series.items()
        for day, use in enumerate(uses)
        if use != "-"
    ]
    items = spark.createDataFrame(rows, ITEM)
    return fact_ops.collection_facts(items), timeline.partition_ranges(
        fact_ops.distinct_snapshots(items)
    )


def column(df, name: str, collection: str) -> list:
    rows = df.filter(df.CollectionName == collection).orderBy("PartitionRank").collect()
    return [row[name] for row in rows]


BASE = {"base": [1, 2, 3, 4, 5]}


def test_before_skips_gaps(spark):
    facts, ranges = tables(spark, BASE | {"c": [5, 7, "-", 7, "-"]})
    grid = history.before_after_grid(facts, ranges)
    assert column(grid, "UseCount", "c") == [5, 7, None, 7, None]
    assert column(grid, "UseCountBefore", "c") == [None, 5, None, 7, None]
    assert column(grid, "IsPurgedCollection", "c") == [False, False, True, False, True]
    status = column(labels.discrete_labels(facts, ranges), "CollectionUseStatus", "c")
    assert status == ["ERROR", "Accessed", "Removed", "Ignored", "Removed"]


def test_created_deleted_and_returned(spark):
    facts, ranges = tables(spark, BASE | {"c": ["-", 0, 0, "-", 2]})
    for rules, third in (("current", "Forgotten"), ("v1", "ERROR")):
        status = column(labels.discrete_labels(facts, ranges, rules), "CollectionUseStatus", "c")
        assert status == ["NotCreated", "Current", third, "Deleted", "Current"]


def test_resets(spark):
    facts, ranges = tables(spark, BASE | {"old": [0, 4, 0, 3, 2], "new": ["-", 4, 0, 3, 2]})
    discrete = labels.discrete_labels(facts, ranges)
    assert column(discrete, "CollectionUseStatus", "old") == [
        "NotLoaded", "Accessed", "NotLoaded", "Accessed", "ERROR",
    ]
    assert column(discrete, "CollectionUseStatus", "new") == [
        "NotCreated", "Current", "ERROR", "Current", "ERROR",
    ]


def test_never_used_is_left_out_and_unreadable_counts_as_absent(spark):
    facts, ranges = tables(spark, BASE | {"idle": [0] * 5, "c": ["-", 3, None, 4, 4]})
    discrete = labels.discrete_labels(facts, ranges)
    assert column(discrete, "CollectionUseStatus", "idle") == []
    assert column(discrete, "CollectionUseStatus", "c") == [
        "NotCreated", "Current", "Deleted", "Current", "Forgotten",
    ]


def test_grid_size_and_edges(spark):
    facts, ranges = tables(
        spark, BASE | {"a": [1, "-", "-", "-", 2], "b": ["-", "-", "-", "-", 1], "z": [0] * 5}
    )
    known = fact_ops.known_collections(facts).count()
    assert known == 3
    assert labels.discrete_labels(facts, ranges).count() == known * 5
    assert history.collection_grid(facts, ranges).count() == known * 5
    policy = labels.policy_labels_of(facts, ranges)
    per_rank = sankey.transitions(policy).groupBy("PartitionRank").sum("EdgeCount").collect()
    assert sorted(tuple(row) for row in per_rank) == [(rank, known) for rank in range(2, 6)]


def test_policy_from_stored_labels_is_the_same(spark):
    facts, ranges = tables(spark, BASE | {"a": [1, 1, 2, 2, 2], "b": ["-", 1, 1, "-", 3]})
    stored = labels.activity_policy_labels(labels.discrete_labels(facts, ranges), 2)
    direct = labels.policy_labels_of(facts, ranges, 2)
    assert sorted(stored.collect()) == sorted(direct.collect())


def test_single_snapshot(spark):
    facts, ranges = tables(spark, {"a": [3], "b": [0]})
    assert column(labels.discrete_labels(facts, ranges), "CollectionUseStatus", "a") == ["ERROR"]
    assert sankey.sankey_edges(sankey.transitions(labels.policy_labels_of(facts, ranges))).count() == 0
    assert sankey.transitions_of_facts(facts, ranges).count() == 0


def test_unnamed_collection_is_always_absent(spark):
    items = spark.createDataFrame(
        [(None, "i", 3, "h", 20000, 1), ("c", "i", 1, "h", 20000, 1), ("c", "i", 2, "h", 20001, 1)],
        ITEM,
    )
    facts = fact_ops.collection_facts(items)
    ranges = timeline.partition_ranges(fact_ops.distinct_snapshots(items))
    rows = labels.discrete_labels(facts, ranges).filter("CollectionName IS NULL")
    got = [(r.UseCount, r.CollectionUseStatus) for r in rows.orderBy("PartitionRank").collect()]
    assert got == [(None, "ERROR"), (None, "Removed")]
    # Index facts come from an inner join on the collection name and so leave the row out.
    index = {(r.days_post_epoch, r.PresentInCollectionCount)
             for r in fact_ops.index_facts(items, facts).collect()}
    assert index == {(20000, 1), (20001, 1)}
