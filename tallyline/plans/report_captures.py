"""Raw reports made from items, as input for the report queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.schema import COLLECTION, DAY, HOST, INDEX, SECOND
from tallyline.sources.reports import TASK_LINES
from tallyline.sources.snapshots import lake_glob, utc_text

# The two directories of a capture, and the order of the lines in its report.
REPORT = [HOST, "snapshot"]
LINE_ORDER = [*REPORT, "collection", "index", "step"]


def report_lines(items: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """The text of the report of each snapshot: lines with their place and sort order, with the noise
    that a real capture carries. ``carried`` maps columns to what the two lines of an item get of it;
    other lines have NULL there."""
    captured = items.withColumn("snapshot", F.concat_ws("_", DAY, SECOND))
    blank = F.lit("")

    def lines(
        rows: DataFrame, offset: int, collection: Column, index: Column, *text: Column, **more: Column
    ) -> DataFrame:
        return rows.select(
            *REPORT,
            collection.alias("collection"),
            index.alias("index"),
            *(more.get(name, F.lit(None)).alias(name) for name in carried or {}),
            F.posexplode(F.array(*text)).alias("step", "line"),
        ).withColumn("step", F.col("step") + offset)

    opening = lines(
        captured.select(*REPORT).distinct(),
        0, blank, blank, F.lit("2024 R simagix/keyhole"), F.lit("index usage"), blank,
    )
    headers = lines(
        captured.select(*REPORT, COLLECTION).distinct(),
        3, F.col(COLLECTION), blank, F.concat(F.col(COLLECTION), F.lit(":")),
    )
    body = lines(
        captured, 4, F.col(COLLECTION), F.col(INDEX),
        F.concat(F.lit("  "), F.col(INDEX), F.lit("  ")),
        F.concat(
            F.lit("    node: ops: "), F.col("UseCount").cast("string"),
            F.lit(", since: "), utc_text(F.col("Since")), F.lit(" +0000 UTC"),
        ),
        **(carried or {}),
    )
    return opening.unionByName(headers).unionByName(body)


def write_reports(lines: DataFrame, root: str, expected: int = 0) -> str:
    """Report lines as text files in capture directories; returns the glob of the directories.

    Lines are dealt by ranges of their order: as many as the session has shuffle partitions, or more,
    so that a task sorts about ``TASK_LINES`` of the ``expected`` lines. A large report is cut into several files, whose names
    begin with the number of their range and so sort in the order of the report.
    """
    shuffled = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 + expected // TASK_LINES
    dealt = lines.repartitionByRange(*([ranges] if ranges > shuffled else []), *LINE_ORDER)
    (
        dealt
        .sortWithinPartitions(*LINE_ORDER)
        .select("line", *REPORT)
        .write.partitionBy(*REPORT)
        .mode("overwrite")
        .text(root)
    )
    return lake_glob(root)
