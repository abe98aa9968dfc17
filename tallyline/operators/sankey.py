"""Transitions between consecutive snapshots, counted as Sankey edges, and their report texts.

Edges are counted from the facts, without the grid of collections and snapshots. Between two facts of
a collection it is absent, and its state is the same all along: a run of ranks. So a fact stands for
two edges at most, into its own rank and out of it, and for a run of edges from the absent state to
itself. Facts alike in all this are counted together, which leaves rows by host and rank whatever the
number of collections. Of a run only its two ends are kept, as +1 and -1, and sums over the ranks of a
host give the runs that cover each rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions.statuses import RULES, policy_status
from tallyline.operators.history import RANK, ranked_facts
from tallyline.operators.labels import DEFAULT_INACTIVITY, with_policy_position
from tallyline.schema import COLLECTION, HOST, SERIES
from tallyline.sources.scratch import stored

# Names shortened in the finished report.
SHORT_NAMES = {
    "NotLoaded": "NL", "NotCreated": "NC", "Active": "A", "Idle": "I", "Restorable": "R",
}
# States whose nodes end a flow and so lose their rank in the finished report.
TERMINAL = ("Deleted", "Inactive")
# The groups of the ordered report; None stands for any state.
REPORT_ORDER = (
    ("NotLoaded", None), ("NotCreated", None),
    ("Active", "Deleted"),
    ("Active", "Active"), ("Restorable", "Active"),
    ("Restorable", "Restorable"),
    ("Active", "Idle"), ("Idle", "Restorable"), ("Idle", "Active"),
    ("Idle", "Idle"), ("Idle", "Inactive"),
)

# The policy states that a collection can have where it is absent.
ABSENT_STATES = ("NotCreated", "Deleted", "ERROR")


def transitions(policy_labels: DataFrame) -> DataFrame:
    """Edge counts by host, rank, and state before and after.

    Keyed on states, not on node texts, so the partial aggregation sees short repeated keys.
    """
    series = Window.partitionBy(*SERIES).orderBy(RANK)
    return (
        policy_labels.select(*SERIES, RANK, F.col("ActivityPolicyStatus").alias("After"))
        .withColumn("Before", F.lag("After").over(series))
        .withColumn("PriorRank", F.lag(RANK).over(series))
        .filter(F.col("Before").isNotNull())
        .groupBy(HOST, RANK, "PriorRank", "Before", "After")
        .agg(F.count("*").alias("EdgeCount"))
    )


def transitions_of_facts(
    facts: DataFrame, ranges: DataFrame, n_inactivity: int = DEFAULT_INACTIVITY, rules: str = "current"
) -> DataFrame:
    """What :func:`transitions` counts from the policy labels of every rank, straight from the facts."""
    runs = stored(fact_runs(facts, ranges, n_inactivity, rules), "fact-runs")
    single = [
        # Into the rank of a fact, and out of it where the collection is absent next.
        runs.where("Before IS NOT NULL").select(HOST, RANK, "Before", "After", "Facts"),
        runs.where("UntilRank > PartitionRank").select(
            HOST, (F.col(RANK) + 1).alias(RANK), F.col("After").alias("Before"), F.col("Gone").alias("After"), "Facts"
        ),
    ]
    kept = [
        _ends(runs.where("UntilRank > PartitionRank + 1"), "Gone", F.col(RANK) + 2, F.col("UntilRank") + 1),
        _ends(runs.where("FromRank < PartitionRank - 1"), "Awaited", F.col("FromRank") + 1, F.col(RANK)),
    ]
    every = [
        ranges.select(HOST, F.col("partition_rank").alias(RANK), F.lit(state).alias("State"), F.lit(0).cast("long").alias("Change"))
        for state in ABSENT_STATES
    ]
    changes = reduce(DataFrame.unionByName, [*(end for ends in kept for end in ends), *every])
    so_far = Window.partitionBy(HOST, "State").orderBy(RANK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasting = (
        changes.groupBy(HOST, "State", RANK)
        .agg(F.sum("Change").alias("Change"))
        .withColumn("Facts", F.sum("Change").over(so_far))
        .where("Facts > 0")
        .select(HOST, RANK, F.col("State").alias("Before"), F.col("State").alias("After"), "Facts")
    )
    counted = reduce(DataFrame.unionByName, [*single, lasting])
    return (
        counted.groupBy(HOST, RANK, (F.col(RANK) - 1).alias("PriorRank"), "Before", "After")
        .agg(F.sum("Facts").alias("EdgeCount"))
    )


def _ends(runs: DataFrame, state: str, first: Column, after: Column) -> list[DataFrame]:
    """A run of ranks as a change where it begins and one after its end."""
    named = (HOST, F.col(state).alias("State"))
    return [
        runs.select(*named, first.alias(RANK), F.col("Facts").alias("Change")),
        runs.select(*named, after.alias(RANK), (-F.col("Facts")).alias("Change")),
    ]


def fact_runs(
    facts: DataFrame, ranges: DataFrame, n_inactivity: int = DEFAULT_INACTIVITY, rules: str = "current"
) -> DataFrame:
    """How many ``Facts`` are alike in host, rank, policy state (``After``), the state at the rank before
    (``Before``, null at rank 1), the last rank before the next fact (``UntilRank``) and the state up to
    there (``Gone``); of the first fact of a collection also the first rank (``FromRank``, otherwise
    its own) and the state from there (``Awaited``)."""
    series = Window.partitionBy(*SERIES).orderBy(RANK)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A row without a collection name matches no snapshot, as in any equi join on the name.
    use = F.when(F.col(COLLECTION).isNotNull(), F.col("UseCount"))
    before = F.when(F.col(COLLECTION).isNotNull(), F.col("use_before"))
    created, nothing = F.col("first_rank") > 1, F.lit(None).cast("long")
    present = (
        ranked_facts(facts, ranges)
        .select(
            *SERIES, RANK, "partition_count", "UseCount",
            F.lag("UseCount").over(series).alias("use_before"),
            F.lag(RANK).over(series).alias("prior_rank"),
            F.lead(RANK).over(series).alias("next_rank"),
            F.min(RANK).over(whole).alias("first_rank"),
            F.sum("UseCount").over(whole).alias("total_use"),
        )
        .filter(F.col("total_use") > 0)
        .withColumn("status", RULES[rules](use, before, created, use.isNull() & (F.col("first_rank") < F.col(RANK))))
    )
    state = with_policy_position(present, n_inactivity, rules, F.col("status"), F.col(RANK))

    def absent(purged: bool) -> Column:
        status = RULES[rules](nothing, nothing, created, F.lit(purged))
        return policy_status(status, F.lit(False), F.lit(False))

    adjacent = F.col("prior_rank") == F.col(RANK) - 1
    told = state.select(
        *SERIES, RANK,
        F.col("ActivityPolicyStatus").alias("After"),
        F.when(adjacent, F.lag("ActivityPolicyStatus").over(series))
        .when(F.col("prior_rank").isNotNull(), absent(True))
        .when(F.col(RANK) > 1, absent(False))
        .alias("Before"),
        F.coalesce(F.col("next_rank") - 1, F.col("partition_count")).alias("UntilRank"),
        absent(True).alias("Gone"),
        F.when(F.col("prior_rank").isNull(), 1).otherwise(F.col(RANK)).alias("FromRank"),
        absent(False).alias("Awaited"),
    )
    return told.groupBy(HOST, RANK, "Before", "After", "UntilRank", "Gone", "FromRank", "Awaited").agg(
        F.count("*").alias("Facts")
    )


def _node(state: str, rank: str) -> Column:
    return F.concat(F.col(state), F.col(rank).cast("string"))


def _edges(counted: DataFrame) -> DataFrame:
    return counted.withColumns(
        {"StateBefore": _node("Before", "PriorRank"), "StateAfter": _node("After", RANK)}
    )


_EDGE_ORDER = [HOST, RANK, "StateBefore", "StateAfter"]


def sankey_edges(counted: DataFrame) -> DataFrame:
    """Counted transitions in report order. Only the aggregated edges are sorted."""
    return (
        _edges(counted)
        .orderBy(*_EDGE_ORDER)
        .select(HOST, "StateBefore", "StateAfter", "EdgeCount")
    )


def _row(before: Column, after: Column) -> Column:
    return F.concat(before, F.lit(" ["), F.col("EdgeCount").cast("string"), F.lit("] "), after)


def sankey_rows(counted: DataFrame) -> DataFrame:
    """All edges as text rows ``before [count] after``, in report order."""
    row = _row(F.col("StateBefore"), F.col("StateAfter"))
    return _edges(counted).orderBy(*_EDGE_ORDER).select(HOST, row.alias("sankey_row"))


def sankey_report(counted: DataFrame) -> DataFrame:
    """The finished report: no flows into the Not… states or out of terminal ones, short names."""

    def short(state: str, rank: str) -> Column:
        name = F.col(state)
        short_name = F.coalesce(
            *(F.when(name == long, F.lit(abbreviated)) for long, abbreviated in SHORT_NAMES.items()),
            name,
        )
        return F.when(name.isin(*TERMINAL), name).otherwise(
            F.concat(short_name, F.col(rank).cast("string"))
        )

    kept = _edges(counted).filter(
        ~F.col("After").startswith("Not") & ~F.col("Before").isin(*TERMINAL)
    )
    row = _row(short("Before", "PriorRank"), short("After", RANK))
    return kept.orderBy(*_EDGE_ORDER).select(HOST, row.alias("sankey_row"))


def sankey_report_ordered(counted: DataFrame) -> DataFrame:
    """Edges grouped by kind of flow in a fixed order; flows outside the groups are left out."""
    group = F.coalesce(
        *(
            F.when(
                (F.col("Before") == before)
                & (F.lit(True) if after is None else F.col("After") == after),
                F.lit(max(position, 1)),
            )
            for position, (before, after) in enumerate(REPORT_ORDER)
        )
    )
    row = _row(F.col("StateBefore"), F.col("StateAfter"))
    return (
        _edges(counted)
        .withColumn("ReportGroup", group)
        .filter(F.col("ReportGroup").isNotNull())
        .orderBy("ReportGroup", *_EDGE_ORDER)
        .select("ReportGroup", HOST, row.alias("sankey_row"))
    )


def write_report(report: DataFrame, path: str) -> None:
    """Report rows as text files per host, all rows and in order."""
    report.select("sankey_row", HOST).write.partitionBy(HOST).mode("overwrite").text(path)
