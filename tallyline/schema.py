"""Tables of the warehouse: columns, partitioning and row order on disk."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    BooleanType,
    DataType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

HOST = "mongo_hostname"
DAY = "days_post_epoch"
SECOND = "seconds_of_day"
COLLECTION = "CollectionName"
INDEX = "IndexName"

SNAPSHOT = [HOST, DAY, SECOND]
SERIES = [HOST, COLLECTION]


def _schema(*columns: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns])


_STRING, _INT, _LONG = StringType(), IntegerType(), LongType()
_SNAPSHOT_FIELDS = ((HOST, _STRING), (DAY, _INT), (SECOND, _INT))


@dataclass(frozen=True)
class Table:
    """One stored table. ``order`` is the row order inside a partition directory; ``lookup`` names
    the columns that get Bloom filters. A ``published`` table keeps generations of whole hosts, of
    which readers see those that the last publication names. A ``log`` only ever grows."""

    name: str
    schema: StructType
    partition_by: list[str]
    order: list[str] = field(default_factory=list)
    lookup: tuple[str, ...] = ()
    published: bool = False
    log: bool = False


OP_COUNT_ITEM = Table(
    "opCountItem",
    _schema(
        (COLLECTION, _STRING), (INDEX, _STRING), ("UseCount", _LONG), ("Since", TimestampType()),
        *_SNAPSHOT_FIELDS,
    ),
    SNAPSHOT,
    [COLLECTION, INDEX],
)

# What a load could not store or read, a row per file with any such thing.
LOAD_ISSUES = Table(
    "loadIssues",
    _schema(
        ("LoadedAt", TimestampType()), ("file_path", _STRING), ("LineCount", _LONG),
        ("UnplacedCount", _LONG), ("OutOfRangeSecondCount", _LONG), ("CorruptCount", _LONG),
        ("NullCollectionNameCount", _LONG), ("NullIndexNameCount", _LONG),
        ("NullUseCountCount", _LONG), ("NullSinceCount", _LONG),
    ),
    [],
    ["file_path"],
    log=True,
)

# Report lines that stand where the grammar does not allow them.
LOAD_ERRORS = Table(
    "loadErrors",
    _schema(
        ("LoadedAt", TimestampType()), *_SNAPSHOT_FIELDS, ("file_path", _STRING), ("line_no", _LONG),
        ("line", _STRING), ("expected", _STRING),
    ),
    [],
    ["file_path", "line_no"],
    log=True,
)

# The captures that each load has touched, also those that it found empty.
LOAD_MANIFEST = Table(
    "loadManifest",
    _schema(*_SNAPSHOT_FIELDS, ("FileCount", _LONG), ("LoadedAt", TimestampType()), ("Load", _LONG)),
    ["Load"],
    SNAPSHOT,
    log=True,
)

COLLECTION_OPS_AGG = Table(
    "collectionOpsAgg",
    _schema(
        *_SNAPSHOT_FIELDS, (COLLECTION, _STRING),
        ("UseCount", _LONG), ("ActiveIndexCount", _LONG), ("TotalIndexCount", _LONG),
    ),
    SNAPSHOT,
    ["-UseCount"],
)

INDEX_OPS_AGG = Table(
    "indexOpsAgg",
    _schema(
        *_SNAPSHOT_FIELDS, (INDEX, _STRING),
        ("UseCount", _LONG), ("ActiveInCollectionCount", _LONG),
        ("LoadedInCollectionCount", _LONG), ("PresentInCollectionCount", _LONG),
    ),
    SNAPSHOT,
    ["-UseCount"],
)

PARTITION_RANGES = Table(
    "partitionRanges",
    _schema(
        (HOST, _STRING), ("partition_rank", _INT), (DAY, _INT), (SECOND, _INT),
        ("this_event_at", _STRING),
        ("prior_days_post", _INT), ("prior_seconds_of", _INT),
        ("since_prior_days_post", _INT), ("since_prior_seconds_of", _INT),
        ("prior_event_at", _STRING),
        ("next_days_post", _INT), ("next_seconds_of", _INT),
        ("until_next_days_post", _INT), ("until_next_seconds_of", _INT),
        ("next_event_at", _STRING),
        ("first_days_post", _INT), ("first_seconds_of", _INT),
        ("since_first_days_post", _INT), ("since_first_seconds_of", _INT),
        ("first_event_at", _STRING), ("is_first_partition", BooleanType()),
        ("last_days_post", _INT), ("last_seconds_of", _INT),
        ("until_last_days_post", _INT), ("until_last_seconds_of", _INT),
        ("last_event_at", _STRING), ("is_last_partition", BooleanType()),
        ("ascending_label", _STRING), ("descending_label", _STRING),
        # Snapshots of the host, so that whoever joins the timeline need not also join hosts.
        ("partition_count", _INT),
    ),
    [HOST],
    ["partition_rank"],
)

COLLECTION_DISCRETE_LABELS = Table(
    "collectionDiscreteLabels",
    _schema(
        *_SNAPSHOT_FIELDS, ("PartitionRank", _INT), (COLLECTION, _STRING), ("UseCount", _LONG),
        ("CollectionUseStatus", _STRING),
    ),
    SNAPSHOT,
    [COLLECTION],
    lookup=(COLLECTION,),
    published=True,
)

COLLECTION_POLICY_LABELS = Table(
    "collectionActivityPolicyLabels",
    _schema(
        *_SNAPSHOT_FIELDS, ("PartitionRank", _INT), (COLLECTION, _STRING), ("UseCount", _LONG),
        ("CollectionUseStatus", _STRING), ("ActivityPolicyStatus", _STRING),
    ),
    [HOST],
    [COLLECTION, "PartitionRank"],
    lookup=(COLLECTION,),
    published=True,
)

# Which generation of each host's rows is the published one of a table.
PUBLICATIONS = Table(
    "publications",
    _schema(
        ("TableName", _STRING), (HOST, _STRING), ("Generation", _STRING), ("Policy", _STRING),
        ("ThroughLoad", _LONG), ("Publication", _LONG),
    ),
    ["Publication"],
    ["TableName", HOST],
    log=True,
)

LEGACY_ACTIVITY_LABELS = Table(
    "collectionActivityLabels",
    _schema(
        (HOST, _STRING), (COLLECTION, _STRING),
        ("AscendingLabel", _STRING), ("ThisEventAt", _STRING), (DAY, _INT), (SECOND, _INT),
        ("CurrentPartitionRank", _INT), ("PriorEventAt", _STRING),
        ("UseCountBefore", _LONG), ("UseCount", _LONG),
        ("ChangedAtRank", _INT), ("ChangedUseStatusTo", _STRING),
        ("CollectionUseStatus", _STRING), ("CollectionUseStatusBefore", _STRING),
        ("IsFutureCollection", BooleanType()), ("IsPurgedCollection", BooleanType()),
        ("PriorChangeRank", _INT), ("PriorChangeStatus", _STRING),
        ("PriorChangeRankTwo", _INT), ("PriorChangeStatusTwo", _STRING),
        ("IsKnownAsOf", TimestampType()),
    ),
    SNAPSHOT,
    [COLLECTION],
)

BASIC_SANKEY = Table(
    "basicSankey",
    _schema(
        (HOST, _STRING), ("AscendingLabel", _STRING), ("CurrentPartitionRank", _INT),
        ("ThisEventAt", _STRING), ("PriorAscendingLabel", _STRING),
        ("CollectionUseStatusBefore", _STRING), ("CollectionUseStatus", _STRING),
        ("PriorEventAt", _STRING), ("EdgeCount", _LONG),
    ),
    [HOST],
    ["CurrentPartitionRank"],
)

TABLES = {
    table.name: table
    for table in (
        OP_COUNT_ITEM, LOAD_ISSUES, LOAD_ERRORS, LOAD_MANIFEST, COLLECTION_OPS_AGG, INDEX_OPS_AGG, PARTITION_RANGES,
        COLLECTION_DISCRETE_LABELS, COLLECTION_POLICY_LABELS, LEGACY_ACTIVITY_LABELS, BASIC_SANKEY,
        PUBLICATIONS,
    )
}
