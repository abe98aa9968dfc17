"""Checks on stored tables: duplicates, row counts, label distributions, start dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators.legacy import first_snapshot_items
from tallyline.schema import COLLECTION, DAY, INDEX, SECOND, SERIES, SNAPSHOT
from tallyline.sources.scratch import stored

# Keys that must be unique per table.
ITEM_KEY = [*SNAPSHOT, COLLECTION, INDEX]
COLLECTION_KEY = [*SNAPSHOT, COLLECTION]
INDEX_KEY = [*SNAPSHOT, INDEX]


def duplicate_keys(table: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.groupBy(*key).agg(F.count("*").alias("RowCount")).filter(F.col("RowCount") > 1)


def snapshot_counts(table: DataFrame) -> DataFrame:
    return table.groupBy(*SNAPSHOT).agg(F.count("*").alias("RowCount")).orderBy(*SNAPSHOT)


def instant_counts(table: DataFrame) -> DataFrame:
    """Rows per instant over all hosts."""
    return table.groupBy(DAY, SECOND).agg(F.count("*").alias("RowCount")).orderBy(DAY, SECOND)


def label_counts(labels: DataFrame, days: Sequence[int], *statuses: str) -> DataFrame:
    """Rows per instant and status on the given days."""
    return (
        labels.filter(F.col(DAY).isin(*days))
        .groupBy(DAY, SECOND, *(statuses or ("CollectionUseStatus",)))
        .agg(F.count("*").alias("LabelCount"))
    )


def label_lookup(labels: DataFrame, collection: str, day: int) -> DataFrame:
    return labels.filter((F.col(COLLECTION) == collection) & (F.col(DAY) == day))


def startup_dates(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """Collections whose counters already ran at the earliest start seen in the first snapshot.

    The earliest start of each host is stored, one row per first snapshot, and joined to the
    items on the whole snapshot key from plain shuffles, so that a host with very many
    collections can be split.
    """
    first = first_snapshot_items(items.filter(F.col("Since").isNotNull()), ranges)
    earliest = stored(first.groupBy(*SNAPSHOT).agg(F.min("Since").alias("PostSince")), "earliest-starts")
    return (
        first.join(earliest, SNAPSHOT)
        .groupBy(*SERIES)
        .agg(F.min("Since").alias("MinSince"), F.min("PostSince").alias("PostSince"))
        .filter(F.col("MinSince") <= F.col("PostSince"))
        .select(*SERIES, "MinSince", "PostSince")
    )


def cohort_overlap(facts: DataFrame, day_a: int, day_b: int) -> DataFrame:
    """How many collections are present on both days.

    One aggregation over the rows of the two days; a self join would shuffle them twice.
    """
    day = F.col(DAY)
    return (
        facts.filter(day.isin(day_a, day_b) & F.col(COLLECTION).isNotNull())
        .groupBy(*SERIES)
        .agg(F.max(day == day_a).alias("on_a"), F.max(day == day_b).alias("on_b"))
        .agg(F.count_if(F.col("on_a") & F.col("on_b")).alias("CollectionCount"))
    )
