"""Delimited snapshot files: ``<lake>/<host>/<day>_<second>/<file>``, one directory per capture."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyline.functions.clock import SECONDS_PER_DAY
from tallyline.functions.paths import snapshot_path_columns
from tallyline.schema import COLLECTION, DAY, HOST, INDEX, LOAD_ISSUES, OP_COUNT_ITEM, SECOND, SNAPSHOT
from tallyline.sources import manifest
from tallyline.sources.scratch import stored, temporary
from tallyline.sources.warehouse import Warehouse

# Fixed name of a capture file.
FILE_NAME = "allCollectionIndices.csv"
# Fixed format of the Since column, with zero to nine digits of fraction.
SINCE_PATTERN = "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS] Z z"
# How nearly all of them are written; a cast reads what is before the zone just as the pattern does.
UTC_SINCE = r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})? [+]0000 UTC\z"

# By position: the header line is skipped and its names ignored.
LINE = StructType(
    [
        StructField(COLLECTION, StringType()),
        StructField(INDEX, StringType()),
        StructField("UseCount", LongType()),
        StructField("Since", StringType()),
        # The whole line, where it has too few or too many fields or one that does not parse.
        StructField("corrupt_line", StringType()),
    ]
)

_REQUIRED = [COLLECTION, INDEX, "UseCount", "Since"]


def since_timestamp(text: Column) -> Column:
    plain = F.concat(F.substring_index(text, " +0000", 1), F.lit("Z"))
    return F.when(text.rlike(UTC_SINCE), plain.try_cast("timestamp")).otherwise(
        F.try_to_timestamp(text, F.lit(SINCE_PATTERN))
    )


def utc_text(instant: Column) -> Column:
    """Milliseconds text of a timestamp in UTC, whatever the session time zone is."""
    return F.date_format(
        F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSS"
    )


def lake_glob(lake_root: str, host: str = "*") -> str:
    return f"{lake_root.rstrip('/')}/{host}/*_*"


def read_snapshots(
    spark: SparkSession, paths: str | Sequence[str], file_name: str = FILE_NAME
) -> DataFrame:
    """Every line of the given capture directories (globs allowed), in one read.

    A field that does not parse is NULL; a path that is not a capture directory leaves host, day
    and second NULL. Nothing is dropped here.
    """
    lines = (
        spark.read.schema(LINE)
        .option("sep", "|")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt_line")
        .option("pathGlobFilter", file_name)
        .csv([paths] if isinstance(paths, str) else list(paths))
    )
    path = F.col("_metadata.file_path")
    return lines.select(
        COLLECTION,
        INDEX,
        "UseCount",
        since_timestamp(F.col("Since")).alias("Since"),
        *snapshot_path_columns(path),
        path.alias("file_path"),
        F.col("corrupt_line").isNotNull().alias("IsCorrupt"),
    )


def placed_items(lines: DataFrame) -> DataFrame:
    """Rows whose capture is known, in the shape of the item table."""
    return lines.filter(_placed()).select(*OP_COUNT_ITEM.schema.names)


def issue_counts() -> list[Column]:
    """Rows without a place in the warehouse, seconds that no day has, lines with a wrong number of
    fields or a field that does not parse, and unreadable fields."""
    return [
        F.count_if(~_placed()).alias("UnplacedCount"),
        F.count_if(F.col(SECOND) >= SECONDS_PER_DAY).alias("OutOfRangeSecondCount"),
        F.count_if("IsCorrupt").alias("CorruptCount"),
        *(F.count_if(F.col(c).isNull()).alias(f"Null{c}Count") for c in _REQUIRED),
    ]


def load_issues(lines: DataFrame) -> DataFrame:
    """The files with any issue, and how often.

    Only rows without a place are not stored; of the others, what could not be read is NULL.
    """
    counted = lines.groupBy("file_path").agg(F.count("*").alias("LineCount"), *issue_counts())
    return counted.filter(F.greatest(*counted.columns[2:]) > 0)


def path_partition_columns(lines: DataFrame) -> DataFrame:
    """Host, day and second found in the paths, with the lines read for each."""
    return lines.groupBy(HOST, DAY, SECOND).agg(F.count("*").alias("LineCount"))


def load_snapshots(
    warehouse: Warehouse,
    lake_root: str,
    host: str = "*",
    file_name: str = FILE_NAME,
) -> None:
    """Load all captures of a lake: one read over all directories, one partitioned write."""
    load_paths(warehouse, [lake_glob(lake_root, host)], file_name)


def load_paths(warehouse: Warehouse, paths: Sequence[str], file_name: str = FILE_NAME) -> None:
    """(Re)load chosen capture directories; the other snapshots of the table stay as they are. A
    capture without rows, or a directory named itself without a file, has no rows afterwards. What
    could not be stored or read is added to the table of issues.

    The raw files are read once. Their staged lines are read once more, by the write, which counts
    the issues on its way; only where there are any, or where captures that the table holds are
    loaded again, are the lines looked at for the files or captures concerned.
    """
    with temporary(warehouse.spark):
        lines = stored(read_snapshots(warehouse.spark, paths, file_name), "snapshot-lines")
        touched = manifest.touched_captures(warehouse.spark, paths, file_name)
        write_items(warehouse, lines, touched)


def write_items(
    warehouse: Warehouse, lines: DataFrame, touched: DataFrame, watched: DataFrame | None = None
) -> None:
    """Store the rows of the touched captures, remove those that have none any more, and report.
    ``watched``: the same rows, for the write alone, if the caller observes it, too."""
    touched = stored(touched, "touched-captures")
    manifest.record(warehouse, touched)
    gone = stored(manifest.emptied(warehouse, OP_COUNT_ITEM.name, touched, lines), "emptied-captures")
    issues = Observation()
    watched = (lines if watched is None else watched).observe(issues, *issue_counts())
    warehouse.write(OP_COUNT_ITEM.name, placed_items(watched))
    warehouse.drop(OP_COUNT_ITEM.name, gone)
    if any(observed(issues).values()):
        warehouse.append(LOAD_ISSUES.name, load_issues(lines))


def observed(counts: Observation) -> dict[str, int]:
    """What was counted on the way of a finished write. Where the planner learnt while running that no
    row comes by, it leaves the counting out, and there is nothing to get."""
    try:
        return counts.get
    except Py4JJavaError:
        return {}


def remove_captures(warehouse: Warehouse, captures: DataFrame) -> None:
    """Forget captures (host, day and second) that are no longer wanted, whatever is on disk."""
    with temporary(warehouse.spark):
        gone = stored(captures.select(*SNAPSHOT).distinct(), "removed-captures")
        manifest.record(warehouse, gone.withColumn("FileCount", F.lit(0).cast("long")))
        warehouse.drop(OP_COUNT_ITEM.name, gone)


def _placed() -> Column:
    """Host, day and second are NULL together, so one of them tells."""
    return F.col(HOST).isNotNull()


def write_snapshots(items: DataFrame, lake_root: str) -> str:
    """Items as delimited capture files, one directory per snapshot (Hive-style names); returns
    the glob of the directories."""
    (
        items.select(
            COLLECTION,
            INDEX,
            "UseCount",
            F.concat(utc_text(F.col("Since")), F.lit(" +0000 UTC")).alias("Since"),
            HOST,
            F.concat_ws("_", DAY, SECOND).alias("snapshot"),
        )
        .hint("rebalance", HOST, "snapshot")
        .write.partitionBy(HOST, "snapshot")
        .option("sep", "|")
        .option("header", True)
        .mode("overwrite")
        .csv(lake_root)
    )
    return lake_glob(lake_root)
