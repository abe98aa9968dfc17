"""Aggregates of raw items per snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.clock import event_epoch
from tallyline.schema import COLLECTION, COLLECTION_OPS_AGG, DAY, INDEX, SECOND, SERIES, SNAPSHOT
from tallyline.sources.warehouse import Warehouse


def collection_facts(items: DataFrame) -> DataFrame:
    """Use count, indexes in use and indexes present, per collection and snapshot."""
    return items.groupBy(*SNAPSHOT, COLLECTION).agg(
        F.sum("UseCount").alias("UseCount"),
        F.count_if(F.col("UseCount") > 0).alias("ActiveIndexCount"),
        F.count("*").alias("TotalIndexCount"),
    )


def index_facts(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Use of each index name over all collections that have it, per snapshot.

    ``LoadedInCollectionCount`` asks whether the owning collection is in use at all, so items meet
    their collection's facts. That is an equi join with one fact row per key: a collection with
    very many indexes is split by the adaptive skew join, which a window over the collection
    could not be. The planner splits only what comes straight from a shuffle, while facts
    aggregated in the same plan would already lie by these keys; joining on one struct of the keys
    makes it shuffle them, the smaller side, for the join.
    """
    named = F.col(COLLECTION).isNotNull()
    owner = F.struct(*SNAPSHOT, COLLECTION).alias("owner")
    owners = facts.filter(named).select(owner, (F.col("ActiveIndexCount") > 0).alias("loaded"))
    return (
        items.filter(named)
        .select(*SNAPSHOT, INDEX, "UseCount", owner)
        .join(owners, "owner")
        .groupBy(*SNAPSHOT, INDEX)
        .agg(
            F.sum("UseCount").alias("UseCount"),
            F.count_if(F.col("UseCount") > 0).alias("ActiveInCollectionCount"),
            F.count_if("loaded").alias("LoadedInCollectionCount"),
            F.count("*").alias("PresentInCollectionCount"),
        )
    )


def recompute_facts(items: DataFrame, warehouse: Warehouse) -> tuple[DataFrame, DataFrame]:
    """Store both fact tables in one run; the index facts reuse the stored collection facts."""
    facts = warehouse.replace(COLLECTION_OPS_AGG.name, collection_facts(items))
    return facts, warehouse.replace("indexOpsAgg", index_facts(items, facts))


def known_collections(facts: DataFrame) -> DataFrame:
    """Collections that were ever used, with the first instant at which they were present."""
    return (
        facts.groupBy(*SERIES)
        .agg(
            F.min(event_epoch(DAY, SECOND)).alias("KnownAsOfEpoch"),
            F.sum("UseCount").alias("TotalUse"),
        )
        .filter(F.col("TotalUse") > 0)
        .select(*SERIES, "KnownAsOfEpoch")
    )


def distinct_snapshots(facts: DataFrame) -> DataFrame:
    """Snapshots with at least one named collection."""
    return facts.filter(F.col(COLLECTION).isNotNull()).select(*SNAPSHOT).distinct()
