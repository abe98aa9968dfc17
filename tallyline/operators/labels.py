"""Discrete use status and policy status of every collection at every snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions.statuses import RULES, in_use, policy_status
from tallyline.operators.history import (
    RANK,
    collection_history,
    ranked_facts,
    with_snapshot_time,
)
from tallyline.schema import COLLECTION_DISCRETE_LABELS, COLLECTION_POLICY_LABELS, SERIES

DEFAULT_INACTIVITY = 14


def discrete_history(
    facts: DataFrame, ranges: DataFrame, rules: str = "current", expected: int = 0
) -> DataFrame:
    """Discrete labels by rank, still without day and second. ``expected``: about how many facts there are."""
    status = RULES[rules](
        F.col("UseCount"),
        F.col("UseCountBefore"),
        F.col("IsCreatedCollection"),
        F.col("IsPurgedCollection"),
    )
    return collection_history(ranked_facts(facts, ranges), expected=expected).select(
        *SERIES, RANK, "UseCount", status.alias("CollectionUseStatus")
    )


def discrete_labels(
    facts: DataFrame, ranges: DataFrame, rules: str = "current", expected: int = 0
) -> DataFrame:
    """The discrete label table."""
    history = discrete_history(facts, ranges, rules, expected)
    return with_snapshot_time(history, ranges).select(*COLLECTION_DISCRETE_LABELS.schema.names)


def with_policy_status(
    labels: DataFrame, n_inactivity: int = DEFAULT_INACTIVITY, rules: str = "current"
) -> DataFrame:
    """Add the policy status under an N-sample inactivity rule.

    N counts samples. The current rules look at N samples including this one, the ``v1`` rules at
    the N samples before it. Both questions, "in use within N samples" and "in use later", are
    answered by the position of the last use so far and of the last use overall: two running
    maxima over one sort, whose cost does not depend on N or on the length of the series.
    """
    series = Window.partitionBy(*SERIES).orderBy(RANK)
    numbered = labels.withColumn("sample", F.row_number().over(series))
    status, sample = F.col("CollectionUseStatus"), F.col("sample")
    return with_policy_position(numbered, n_inactivity, rules, status, sample).drop("sample")


def with_policy_position(
    rows: DataFrame, n_inactivity: int, rules: str, use_status: Column, sample: Column
) -> DataFrame:
    """The same, with the number of each row's sample given: rows on which nothing is in use may then
    be missing."""
    if n_inactivity < 1:
        raise ValueError("the inactivity period must be at least one sample")
    reach = {"current": n_inactivity - 1, "v1": n_inactivity}[rules]

    series = Window.partitionBy(*SERIES).orderBy(RANK)
    so_far = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    used_at = F.when(in_use(use_status), sample)

    status = policy_status(
        use_status,
        recently_active=sample - F.col("last_use_so_far") <= reach,
        active_later=F.col("last_use") > sample,
    )
    return (
        rows.withColumn("last_use_so_far", F.max(used_at).over(so_far))
        .withColumn("last_use", F.max(used_at).over(whole))
        .withColumn("ActivityPolicyStatus", status)
        .drop("last_use_so_far", "last_use")
    )


def activity_policy_labels(
    labels: DataFrame, n_inactivity: int = DEFAULT_INACTIVITY, rules: str = "current"
) -> DataFrame:
    """The policy label table, from the discrete label table."""
    return with_policy_status(labels, n_inactivity, rules).select(
        *COLLECTION_POLICY_LABELS.schema.names
    )


def policy_labels_of(
    facts: DataFrame,
    ranges: DataFrame,
    n_inactivity: int = DEFAULT_INACTIVITY,
    rules: str = "current",
    expected: int = 0,
) -> DataFrame:
    """The policy label table straight from facts.

    Both labels are assigned by rank in one pass over the series; day and second are joined last,
    so even a timeline too large to broadcast does not come between two windows.
    """
    labelled = with_policy_status(discrete_history(facts, ranges, expected=expected), n_inactivity, rules)
    return with_snapshot_time(labelled, ranges).select(*COLLECTION_POLICY_LABELS.schema.names)
