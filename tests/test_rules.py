"""Truth tables of the status rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyline.functions.statuses import POLICY_STATUSES, RULES, USE_STATUSES
from tallyline.operators.labels import with_policy_status

# use, before, created, purged -> status under current rules, under v1 rules
CASES = [
    (None, None, True, True, "Deleted", "Deleted"),
    (None, None, True, False, "NotCreated", "NotCreated"),
    (None, 3, True, False, "NotCreated", "ERROR"),
    (None, None, False, True, "Removed", "Removed"),
    (None, None, False, False, "ERROR", "ERROR"),
    (0, None, True, False, "Current", "Current"),
    (5, None, True, False, "Current", "Current"),
    (5, 4, True, False, "Current", "Current"),
    (5, 5, True, False, "Forgotten", "Forgotten"),
    (0, 0, True, False, "Forgotten", "ERROR"),
    (4, 5, True, False, "ERROR", "ERROR"),
    (0, 5, True, False, "ERROR", "ERROR"),
    (0, None, False, False, "NotLoaded", "NotLoaded"),
    (0, 0, False, False, "NotLoaded", "NotLoaded"),
    (0, 5, False, False, "NotLoaded", "NotLoaded"),
    (5, 4, False, False, "Accessed", "Accessed"),
    (5, 0, False, False, "Accessed", "Accessed"),
    (5, 5, False, False, "Ignored", "Ignored"),
    (4, 5, False, False, "ERROR", "ERROR"),
    (5, None, False, False, "ERROR", "Accessed"),
]


@pytest.mark.parametrize("rules,column", [("current", 4), ("v1", 5)])
def test_discrete_rules(spark, rules, column):
    df = spark.createDataFrame(
        [(i, *case[:4]) for i, case in enumerate(CASES)],
        "i int, use bigint, before bigint, created boolean, purged boolean",
    )
    status = RULES[rules](F.col("use"), F.col("before"), F.col("created"), F.col("purged"))
    got = [row.status for row in df.select("i", status.alias("status")).orderBy("i").collect()]
    assert got == [case[column] for case in CASES]
    assert set(got) <= set(USE_STATUSES)


# One letter per sample.
DISCRETE = {
    "n": "NotCreated", "l": "NotLoaded", "c": "Current", "a": "Accessed", "f": "Forgotten",
    "i": "Ignored", "d": "Deleted", "r": "Removed", "e": "ERROR",
}
POLICY = {
    "N": "NotCreated", "L": "NotLoaded", "A": "Active", "I": "Idle", "R": "Restorable",
    "X": "Inactive", "D": "Deleted", "E": "ERROR",
}
SERIES = [
    # samples, n, rules, expected
    ("ncfffcfff", 3, "current", "NAIIRAIIX"),
    ("ncfffcfff", 3, "v1", "NAIIIAIII"),
    ("ncfffcfff", 2, "v1", "NAIIRAIIX"),
    ("ncfffcfff", 1, "current", "NARRRAXXX"),
    ("laiiir", 2, "current", "LAIXXD"),
    ("laiiaed", 14, "current", "LAIIAED"),
    ("iiia", 14, "current", "RRRA"),
    ("f", 14, "current", "X"),
    ("c", 1, "current", "A"),
]


@pytest.mark.parametrize("samples,n,rules,expected", SERIES)
def test_policy(spark, samples, n, rules, expected):
    rows = [("h", "x", i + 1, DISCRETE[s]) for i, s in enumerate(samples)]
    rows += [("h", "other", i + 1, "Current") for i in range(len(samples))]
    labels = spark.createDataFrame(
        rows, "mongo_hostname string, CollectionName string, PartitionRank int, "
        "CollectionUseStatus string",
    )
    got = with_policy_status(labels, n, rules).filter("CollectionName = 'x'")
    statuses = [r.ActivityPolicyStatus for r in got.orderBy("PartitionRank").collect()]
    assert statuses == [POLICY[e] for e in expected]
    assert set(statuses) <= set(POLICY_STATUSES)


@pytest.mark.parametrize("n", [0, -1])
def test_policy_rejects_empty_period(spark, n):
    labels = spark.createDataFrame([], "mongo_hostname string, CollectionName string, "
                                       "PartitionRank int, CollectionUseStatus string")
    with pytest.raises(ValueError):
        with_policy_status(labels, n)
