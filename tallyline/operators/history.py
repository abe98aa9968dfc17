"""Every known collection at every snapshot of its host.

The dense grid is not joined together from collections and snapshots. The facts are ordered per
(host, collection) once; each present row then knows the rank of the next one and emits itself
and the absent snapshots up to there. The only shuffle is of the facts, and every later window
over (host, collection) finds its rows in place.

Ranks alone carry this: ``partition_rank`` is dense per host and rises with time, so a collection
is *created* if its first rank is above 1 and *purged* where it is absent above its first rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions.clock import event_epoch
from tallyline.schema import COLLECTION, DAY, HOST, SECOND, SERIES, SNAPSHOT

RANK = "PartitionRank"
# A task sorts about so many facts at once.
SERIES_ROWS = 1 << 18
_COUNTS = ("UseCount", "ActiveIndexCount", "TotalIndexCount")


def ranked_facts(facts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Facts with the rank of their snapshot and the number of snapshots of their host.

    A plain equi join: the planner broadcasts the timeline if its stored size is under the
    broadcast threshold, and otherwise shuffles with adaptive skew handling. Everything needed of
    the host comes along, because a further join on the host alone would, when shuffled, leave
    all of a host's rows in one task for the windows that follow.
    """
    ranks = ranges.select(*SNAPSHOT, F.col("partition_rank").alias(RANK), "partition_count")
    return facts.join(ranks, SNAPSHOT)


def by_series(rows: DataFrame, expected: int = 0) -> DataFrame:
    """Rows dealt by series to more tasks than the session has shuffle partitions, where these would get
    over ``SERIES_ROWS`` of the ``expected`` rows each. The windows that follow find them in place."""
    tasks = 1 + expected // SERIES_ROWS
    if tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows
    return rows.repartition(tasks, *SERIES)


def collection_history(
    ranked: DataFrame, carried: dict[str, str] | None = None, expected: int = 0
) -> DataFrame:
    """The dense history of every collection that was ever used. ``expected``: about how many facts
    there are, see :func:`by_series`.

    ``carried`` maps result columns to SQL aggregates over the whole series, for callers that
    need more of it than its first rank.
    """
    series = Window.partitionBy(*SERIES).orderBy(RANK)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = carried or {}

    present = by_series(ranked, expected).select(
        *SERIES,
        RANK,
        "partition_count",
        *_COUNTS,
        F.lag("UseCount").over(series).alias("UseCountBefore"),
        F.lead(RANK).over(series).alias("next_rank"),
        F.min(RANK).over(whole).alias("first_rank"),
        F.sum("UseCount").over(whole).alias("total_use"),
        *(F.expr(aggregate).over(whole).alias(name) for name, aggregate in carried.items()),
    ).filter(F.col("total_use") > 0)

    run_start = F.when(F.col(RANK) == F.col("first_rank"), 1).otherwise(F.col(RANK))
    run_end = F.coalesce(F.col("next_rank") - 1, F.col("partition_count"))
    dense = present.withColumn("grid_rank", F.explode(F.sequence(run_start, run_end)))

    # A row without a collection name matches no snapshot, as in any equi join on the name.
    here = (F.col("grid_rank") == F.col(RANK)) & F.col(COLLECTION).isNotNull()
    use = F.when(here, F.col("UseCount"))
    return dense.select(
        *SERIES,
        F.col("grid_rank").alias(RANK),
        *(F.when(here, F.col(c)).alias(c) for c in _COUNTS),
        F.when(here, F.col("UseCountBefore")).alias("UseCountBefore"),
        (use.isNull() & (F.col("first_rank") < F.col("grid_rank"))).alias("IsPurgedCollection"),
        (F.col("first_rank") > 1).alias("IsCreatedCollection"),
        *carried,
    )


def with_snapshot_time(df: DataFrame, ranges: DataFrame, *extra: str) -> DataFrame:
    """Add day and second (and ``extra`` timeline columns) to rows that carry host and rank."""
    times = ranges.select(HOST, F.col("partition_rank").alias(RANK), DAY, SECOND, *extra)
    return df.join(times, [HOST, RANK])


def before_after_grid(facts: DataFrame, ranges: DataFrame, expected: int = 0) -> DataFrame:
    history = collection_history(ranked_facts(facts, ranges), expected=expected)
    return with_snapshot_time(history, ranges).select(
        *SNAPSHOT, RANK, COLLECTION, *_COUNTS,
        "UseCountBefore", "IsPurgedCollection", "IsCreatedCollection",
    )


def collection_grid(facts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Known collections times the snapshots of their host, present or not."""
    known = (
        ranked_facts(facts, ranges)
        .groupBy(*SERIES)
        .agg(
            F.min(event_epoch(DAY, SECOND)).alias("KnownAsOfEpoch"),
            F.sum("UseCount").alias("total_use"),
            F.max("partition_count").alias("partition_count"),
        )
        .filter(F.col("total_use") > 0)
    )
    dense = known.withColumn(RANK, F.explode(F.sequence(F.lit(1), F.col("partition_count"))))
    return with_snapshot_time(dense, ranges).select(*SNAPSHOT, RANK, COLLECTION, "KnownAsOfEpoch")
