"""The earlier activity labels, dated by the counters' own start times, with change navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions.clock import event_epoch
from tallyline.functions.statuses import v1_rules
from tallyline.operators.history import (
    RANK,
    collection_history,
    ranked_facts,
    with_snapshot_time,
)
from tallyline.schema import (
    BASIC_SANKEY,
    COLLECTION,
    DAY,
    HOST,
    LEGACY_ACTIVITY_LABELS,
    SECOND,
    SERIES,
    SNAPSHOT,
)
from tallyline.sources.scratch import stored

# Names that these labels leave out.
EXCLUDED_NAMES = ("audit%", "%AnnotationSource.metas%")


def _tracked() -> Column:
    name = F.col(COLLECTION)
    tracked = name.isNotNull()
    for pattern in EXCLUDED_NAMES:
        tracked = tracked & ~name.like(pattern)
    return tracked


def known_collections_legacy(items: DataFrame) -> DataFrame:
    """Tracked collections that were ever used, with the earliest start of their counters."""
    return (
        items.filter(_tracked())
        .groupBy(*SERIES)
        .agg(F.min("Since").alias("IsKnownAsOf"), F.sum("UseCount").alias("TotalUse"))
        .filter(F.col("TotalUse") > 0)
        .select(*SERIES, "IsKnownAsOf")
    )


# Up to so many hosts, their first snapshots are written into the plan.
LISTED_HOSTS = 1000


def first_snapshot_items(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """Items of the first snapshot of each host.

    The first snapshots, one row per host, are stored, so the planner knows how small they are.
    If they are few they are also listed in a filter on the partition columns, which keeps all
    other snapshot directories unread even where nothing is broadcast.
    """
    firsts = stored(ranges.filter("partition_rank = 1").select(*SNAPSHOT), "first-snapshots")
    listed = firsts.limit(LISTED_HOSTS + 1).collect()
    if len(listed) <= LISTED_HOSTS:
        names = ["/".join(map(str, row)) for row in listed]
        items = items.filter(F.concat_ws("/", *SNAPSHOT).isin(names))
    return items.join(firsts, SNAPSHOT)


def initial_future_date(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """Latest counter start in the first snapshot of each host: what starts later is new."""
    return (
        first_snapshot_items(items, ranges)
        .groupBy(HOST)
        .agg(F.max("Since").alias("InitialFutureDate"))
    )


def legacy_facts(items: DataFrame) -> DataFrame:
    return (
        items.filter(_tracked())
        .groupBy(*SNAPSHOT, COLLECTION)
        .agg(
            F.sum("UseCount").alias("UseCount"),
            F.count_if(F.col("UseCount") > 0).alias("ActiveIndexCount"),
            F.count("*").alias("TotalIndexCount"),
            F.min("Since").alias("Since"),
        )
    )


def dated_ranges(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """The timeline with the horizon of each host on all its snapshots. Store it before use: the
    labels then join one small table of known size, on host and rank. The horizons, one row per
    host, are stored too; only the timeline is joined by host, never the collections."""
    return ranges.join(stored(initial_future_date(items, ranges), "horizons"), HOST)


def legacy_activity_labels(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """The legacy label table, from items and :func:`dated_ranges`."""
    ranked = ranked_facts(legacy_facts(items), ranges)
    history = collection_history(ranked, {"IsKnownAsOf": "min(Since)"}).drop(
        "IsPurgedCollection", "IsCreatedCollection"
    )
    event_micros = event_epoch(DAY, SECOND) * F.lit(1_000_000)
    future = F.col("IsFutureCollection")
    status = v1_rules(
        F.col("UseCount"), F.col("UseCountBefore"), future, F.col("IsPurgedCollection")
    )
    labelled = (
        with_snapshot_time(
            history,
            ranges,
            "ascending_label",
            "this_event_at",
            "prior_event_at",
            "InitialFutureDate",
        )
        .withColumn("IsFutureCollection", F.col("InitialFutureDate") < F.col("IsKnownAsOf"))
        .withColumn(
            "IsPurgedCollection",
            F.col("UseCount").isNull() & (F.unix_micros("IsKnownAsOf") < event_micros),
        )
        .withColumn("CollectionUseStatus", F.when(future.isNull(), "ERROR").otherwise(status))
    )
    return change_navigation(labelled).select(
        *SERIES,
        F.col("ascending_label").alias("AscendingLabel"),
        F.col("this_event_at").alias("ThisEventAt"),
        DAY,
        SECOND,
        F.col(RANK).alias("CurrentPartitionRank"),
        F.col("prior_event_at").alias("PriorEventAt"),
        *LEGACY_ACTIVITY_LABELS.schema.names[8:],
    )


def change_navigation(labels: DataFrame) -> DataFrame:
    """Previous status, change markers, and the change before this row.

    The second pair of columns looks back among rows of the same kind only, changed or
    unchanged. Picking the latest row of either kind and choosing by the row's own kind needs no
    partitioning by that flag, so every column comes out of the same sorted series.
    """
    series = Window.partitionBy(*SERIES).orderBy(RANK)
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    status = F.col("CollectionUseStatus")
    changed = F.col("changed")
    here = F.struct(F.col(RANK).alias("rank"), status.alias("status"))

    def latest(condition: Column) -> Column:
        return F.last(F.when(condition, here), ignorenulls=True).over(earlier)

    return (
        labels.withColumn("CollectionUseStatusBefore", F.lag(status).over(series))
        .withColumn("changed", ~F.col("CollectionUseStatusBefore").eqNullSafe(status))
        .withColumn("ChangedAtRank", F.when(changed, F.col(RANK)))
        .withColumn("ChangedUseStatusTo", F.when(changed, status))
        .withColumn("last_change", latest(changed))
        .withColumn("last_same", latest(~changed))
        .withColumn("last_alike", F.when(changed, F.col("last_change")).otherwise(F.col("last_same")))
        .withColumns(
            {
                "PriorChangeRank": F.col("last_change.rank"),
                "PriorChangeStatus": F.col("last_change.status"),
                "PriorChangeRankTwo": F.col("last_alike.rank"),
                "PriorChangeStatusTwo": F.col("last_alike.status"),
            }
        )
        .drop("changed", "last_change", "last_same", "last_alike")
    )


def basic_sankey(legacy_labels: DataFrame, ranges: DataFrame) -> DataFrame:
    """Status transitions per host and snapshot, named by the labels of both snapshots.

    Counted first; only the counts are joined to the timeline.
    """
    keys = [
        HOST, "AscendingLabel", "CurrentPartitionRank", "ThisEventAt", "PriorEventAt",
        "CollectionUseStatusBefore", "CollectionUseStatus",
    ]
    counts = (
        legacy_labels.filter(F.col("PriorEventAt").isNotNull())
        .groupBy(*keys)
        .agg(F.count("*").alias("EdgeCount"))
    )
    prior = ranges.select(
        HOST,
        (F.col("partition_rank") + 1).alias("CurrentPartitionRank"),
        F.col("ascending_label").alias("PriorAscendingLabel"),
    )
    return counts.join(prior, [HOST, "CurrentPartitionRank"]).select(*BASIC_SANKEY.schema.names)
