"""Raw index reports: plain text, one per capture directory, in one file or several.

A report holds, per collection, a header line ``<db>…:`` and, per index, a ``{…}`` line followed
by a line with ``ops: <n>, since: <time> UTC``. What a line means depends on the lines before it,
so order matters; yet one report may be far larger than a task can hold. A report may therefore
be cut into files whose names sort in its order, and files are read in ordinary splits. The lines of
a split (file, block) are cut into pieces of a fixed number of lines. Windows run inside a piece only,
and what a piece inherits from earlier pieces of its report (line count, latest header, last line)
comes from a one-row-per-piece summary. Pieces are dealt to tasks by their number, so a task holds
about ``TASK_LINES`` lines, whatever the size of the reports and the session's shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions.paths import snapshot_path_columns
from tallyline.schema import COLLECTION, INDEX, LOAD_ERRORS, SNAPSHOT
from tallyline.sources.manifest import touched_captures
from tallyline.sources.scratch import stored, temporary
from tallyline.sources.snapshots import observed, placed_items, since_timestamp, write_items
from tallyline.sources.warehouse import Warehouse

# Fixed names: the file of a capture, and the database whose collections are reported.
FILE_NAME = "idx.log"
DEFAULT_DB = "loadtest"

# Lines that carry no facts.
NOISE = ("R simagix/keyhole", "is larger than the max int32", "I GetIndexes ends")
# Fixed pattern of a counter line.
OPS_LINE = r"ops: ([0-9]+), since: (.* UTC)"

# A piece holds at most 2**PIECE_BITS lines of a block, a task about so many lines.
PIECE_BITS = 12
TASK_LINES = 1 << 18

_BLOCK = ["file_path", "block"]
_PIECE = [*_BLOCK, "piece"]


def read_reports(
    spark: SparkSession, paths: str | Sequence[str], file_name: str = FILE_NAME
) -> DataFrame:
    """Lines of the reports with their place: file, block of the file, order inside the block.

    A task reads the lines of its split in order, so the running row id orders them; blocks are
    ordered by their byte offset.
    """
    return (
        spark.read.option("pathGlobFilter", file_name)
        .text([paths] if isinstance(paths, str) else list(paths))
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.col("value").alias("line"),
        )
    )


def clean_lines(lines: DataFrame) -> DataFrame:
    """Strip text before the first ``{`` and after the last ``}``; drop blank and noise lines."""
    line = F.col("line")
    opened = F.when(line.contains("{"), line.substr(F.instr(line, "{"), F.length(line)))
    opened = F.coalesce(opened, line)
    trailing = F.length(F.substring_index(opened, "}", -1))
    closed = F.when(
        opened.contains("}"), opened.substr(F.lit(1), F.length(opened) - trailing)
    )
    cleaned = lines.withColumn("line", F.coalesce(closed, opened)).filter(line != "")
    for marker in NOISE:
        cleaned = cleaned.filter(~line.contains(marker))
    return cleaned


def classified_lines(cleaned: DataFrame, db_name: str = DEFAULT_DB) -> DataFrame:
    """Each line with its kind and, on collection lines, the collection name.

    A collection line is ``<db>…:``, an index line ``{…}``, an opcount line holds the counter.
    """
    line = F.col("line")
    return cleaned.withColumn(
        "kind",
        F.when(line.startswith(db_name) & line.endswith(":") & (F.length(line) > len(db_name)),
               "collection")
        .when(line.startswith("{") & line.endswith("}") & (F.length(line) > 1), "index")
        .when(line.contains("ops: ") & line.rlike(OPS_LINE), "opcount")
        .otherwise("other"),
    ).withColumn(
        "collection",
        F.when(F.col("kind") == "collection", line.substr(F.lit(1), F.length(line) - 1)),
    )


def _header() -> Column:
    return F.when(F.col("kind") == "collection", F.struct("collection", "seq"))


def _line() -> Column:
    return F.struct("kind", "line")


def task_count(pieces: DataFrame) -> int:
    """Over how many tasks lines are dealt, given the ``lines`` of every piece."""
    return 1 + (pieces.agg(F.sum("lines")).first()[0] or 0) // TASK_LINES


def _inherited(lines: DataFrame) -> DataFrame:
    """One row per piece: its lines, and what it inherits from those before it in its report.

    First the places of each piece's ends and latest header are found, then the lines at these few
    places are fetched."""
    found = stored(
        lines.groupBy(*_PIECE).agg(
            F.count("*").alias("lines"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.max(F.when(F.col("kind") == "collection", F.col("seq"))).alias("header_seq"),
        ),
        "report-pieces",
    )
    wanted = found.select(F.explode(F.array("last_seq", "header_seq")).alias("seq")).distinct()
    ends = stored(lines.join(wanted, "seq", "left_semi").select("seq", "collection", "kind", "line"), "report-ends")
    header = ends.select(F.col("seq").alias("header_seq"), _header().alias("header"))
    last = ends.select(F.col("seq").alias("last_seq"), _line().alias("last_line"))
    summary = found.join(header, "header_seq", "left").join(last, "last_seq")

    directory = F.regexp_replace("file_path", "/[^/]*$", "")
    by_piece = Window.partitionBy(directory).orderBy(*_PIECE)
    earlier = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    opening = F.lag("first_seq").over(by_piece).isNull()
    return stored(
        summary.withColumn("line_0", F.when(opening, F.col("first_seq")))
        .withColumn("header", F.when(~F.col("header.seq").eqNullSafe(F.col("line_0")), F.col("header")))
        .select(
            *_PIECE,
            *snapshot_path_columns(F.col("file_path")),
            "lines",
            "line_0",
            F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("lines_before"),
            F.last("header", ignorenulls=True).over(earlier).alias("header_before"),
            F.lag("last_line").over(by_piece).alias("prior_before"),
        ),
        "report-summary",
    )


def numbered_lines(classified: DataFrame) -> DataFrame:
    """Lines with the snapshot and number in their report, their collection, and the line before.

    Line 0 opens the report and is read past, whatever it says: it starts no collection and
    precedes nothing.

    ``classified`` is read more than once and all reads must see the same blocks, so pass a stored table
    (see :func:`staged_lines`): splits of raw text may differ from one scan to the next. The summary is
    made here, from numbers that are counted before they are shuffled.
    """
    lines = classified.withColumn("piece", F.shiftright("seq", PIECE_BITS))
    inherited = _inherited(lines)
    in_piece = Window.partitionBy(*_PIECE).orderBy("seq")
    so_far = in_piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    placed = lines.repartition(task_count(inherited), *_PIECE).select(
        *_PIECE,
        "line",
        "kind",
        F.row_number().over(in_piece).alias("row"),
        F.last(_header(), ignorenulls=True).over(so_far).alias("header_here"),
        F.lag(_line()).over(in_piece).alias("prior_here"),
    )

    line_no = F.col("lines_before") + F.col("row") - 1
    own_header = F.when(
        ~F.col("header_here.seq").eqNullSafe(F.col("line_0")), F.col("header_here.collection")
    )
    return placed.join(inherited, _PIECE).select(
        "file_path",
        *SNAPSHOT,
        line_no.alias("line_no"),
        "line",
        "kind",
        F.coalesce(own_header, F.col("header_before.collection")).alias("collection"),
        F.when(line_no > 1, F.coalesce("prior_here", "prior_before")).alias("prior"),
    )


def _expected() -> Column:
    """Kind of line that may stand here, judged by the previous line and the header so far.

    After a line out of place, the next index or collection line is accepted again, so one bad
    line is reported once.
    """
    prior = F.col("prior.kind")
    return (
        F.when(prior == "collection", "index")
        .when(prior == "index", "opcount")
        .when(F.col("collection").isNull(), "collection")
        .otherwise("index or collection")
    )


def report_items(numbered: DataFrame) -> DataFrame:
    """One item per ops line that directly follows an index line under a collection header."""
    return numbered.filter(
        (F.col("kind") == "opcount")
        & (F.col("prior.kind") == "index")
        & F.col("collection").isNotNull()
    ).select(
        F.col("collection").alias(COLLECTION),
        F.col("prior.line").alias(INDEX),
        F.regexp_extract("line", OPS_LINE, 1).try_cast("bigint").alias("UseCount"),
        since_timestamp(F.regexp_extract("line", OPS_LINE, 2)).alias("Since"),
        *SNAPSHOT,
        "file_path",
        F.lit(False).alias("IsCorrupt"),
    )


def _misplaced() -> Column:
    """Whether the grammar does not allow the line where it stands."""
    expected = _expected()
    allowed = F.when(expected == "index or collection", F.col("kind").isin("index", "collection"))
    return (F.col("line_no") > 0) & ~allowed.otherwise(F.col("kind") == expected)


def report_errors(numbered: DataFrame) -> DataFrame:
    """Lines that the grammar does not allow where they stand; all of them, not just the first."""
    return numbered.filter(_misplaced()).select(
        *SNAPSHOT, "file_path", "line_no", "line", _expected().alias("expected")
    )


def staged_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    db_name: str = DEFAULT_DB,
    file_name: str = FILE_NAME,
) -> DataFrame:
    """Classified lines of all reports, stored once in the shared scratch folder."""
    cleaned = clean_lines(read_reports(spark, paths, file_name))
    return stored(classified_lines(cleaned, db_name), "report-lines")


def parse_reports(
    spark: SparkSession,
    paths: str | Sequence[str],
    db_name: str = DEFAULT_DB,
    file_name: str = FILE_NAME,
) -> DataFrame:
    """Items of all reports under ``paths``, in the shape of the item table."""
    return placed_items(report_items(numbered_lines(staged_lines(spark, paths, db_name, file_name))))


def load_reports(
    warehouse: Warehouse, paths: str | Sequence[str], db_name: str = DEFAULT_DB, file_name: str = FILE_NAME
) -> None:
    """Reports straight into the item table; items that have no place there or unreadable fields
    are counted in the table of issues, and lines out of place are listed in that of errors. A report
    without items leaves none of its capture. The raw files are read once, and their staged lines
    are removed at the end; the write counts errors and issues, which are looked for if there are any.
    """
    with temporary(warehouse.spark):
        numbered = numbered_lines(staged_lines(warehouse.spark, paths, db_name, file_name))
        touched = touched_captures(warehouse.spark, paths, file_name)
        errors = Observation()
        judged = numbered.observe(errors, F.count_if(_misplaced()).alias("errors"))
        write_items(warehouse, report_items(numbered), touched, report_items(judged))
        if observed(errors).get("errors"):
            warehouse.append(LOAD_ERRORS.name, report_errors(numbered))
