"""One registered query per operator, over an event log mapped to items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.paths import snapshot_path_columns
from tallyline.operators import facts as fact_ops
from tallyline.operators import history, labels, legacy, quality, sankey, timeline
from tallyline.plans import report_captures
from tallyline.plans.prepared import (
    LINES_PER_ITEM,
    csv_lake,
    emptied_warehouse,
    event_warehouse,
    labelled_warehouse,
    report_lake,
    reportable,
)
from tallyline.schema import (
    COLLECTION,
    COLLECTION_DISCRETE_LABELS,
    COLLECTION_OPS_AGG,
    COLLECTION_POLICY_LABELS,
    DAY,
    HOST,
    INDEX,
    LOAD_ERRORS,
    LOAD_ISSUES,
    OP_COUNT_ITEM,
    PARTITION_RANGES,
    SECOND,
    SNAPSHOT,
    Table,
)
from tallyline.sources import recent, reports, snapshots
from tallyline.sources.scratch import scratch_folder, stored
from tallyline.sources.warehouse import Warehouse

# Fixed parameters of the registered queries.
LABEL_DAYS = (19730, 19745)
COHORT_DAYS = (19725, 19750)
LOOKUP = ("c2_click", 19745)
COPIED_DAY = 19730
REWRITTEN_DAY = 19740
REWRITTEN_HOST = "mongo02"
EARLIER_DAYS = "197[23]?"
EMPTIED_HOSTS = ("mongo02", "mongo03")


class Inputs:
    """What a query reads: stored items and timeline, and the tables derived from them."""

    def __init__(self, spark: SparkSession, data_dir: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.data_dir = data_dir
        warehouse = event_warehouse(spark, data_dir)
        self.items = warehouse.read(OP_COUNT_ITEM.name)
        self.ranges = warehouse.read(PARTITION_RANGES.name)

    def csv_lake(self) -> str:
        return csv_lake(self.spark, self.data_dir)

    def report_lake(self) -> str:
        return report_lake(self.spark, self.data_dir)

    def stored(self, table: Table) -> DataFrame:
        """A table that the jobs have filled, for queries on stored facts and labels."""
        return labelled_warehouse(self.spark, self.data_dir).read(table.name)

    @property
    def facts(self) -> DataFrame:
        return fact_ops.collection_facts(self.items)

    @property
    def expected(self) -> int:
        """About how many facts there are: collections have two indexes. Only footers are read."""
        return self.items.count() // 2

    @property
    def index_facts(self) -> DataFrame:
        return fact_ops.index_facts(self.items, self.facts)

    def discrete(self, rules: str = "current") -> DataFrame:
        return labels.discrete_labels(self.facts, self.ranges, rules, self.expected)

    def policy(self, n: int = labels.DEFAULT_INACTIVITY, rules: str = "current") -> DataFrame:
        return labels.policy_labels_of(self.facts, self.ranges, n, rules, self.expected)

    def transitions(self) -> DataFrame:
        return sankey.transitions_of_facts(self.facts, self.ranges)

    def legacy_labels(self) -> DataFrame:
        dated = stored(legacy.dated_ranges(self.items, self.ranges), "dated-ranges")
        return legacy.legacy_activity_labels(self.items, dated)


# --- sources ---------------------------------------------------------------------------------


def load_snapshot_csv(inputs: Inputs) -> DataFrame:
    warehouse = Warehouse.scratch(inputs.spark)
    snapshots.load_paths(warehouse, [inputs.csv_lake()], "*.csv")
    return warehouse.read(OP_COUNT_ITEM.name)


def path_partition_columns(inputs: Inputs) -> DataFrame:
    lines = snapshots.read_snapshots(inputs.spark, inputs.csv_lake(), "*.csv")
    return snapshots.path_partition_columns(lines)


def reload_one_snapshot(inputs: Inputs) -> DataFrame:
    """A table with wrong counts in one snapshot, whose directory is then loaded again."""
    wrong = (F.col(DAY) == REWRITTEN_DAY) & (F.col(HOST) == REWRITTEN_HOST)
    spoiled = inputs.items.withColumn(
        "UseCount", F.when(wrong, F.col("UseCount") + 1000).otherwise(F.col("UseCount"))
    )
    warehouse = Warehouse.scratch(inputs.spark)
    warehouse.write(OP_COUNT_ITEM.name, spoiled)
    one_snapshot = inputs.csv_lake().replace("*/*_*", f"*{REWRITTEN_HOST}/*{REWRITTEN_DAY}_*")
    snapshots.load_paths(warehouse, [one_snapshot], "*.csv")
    return warehouse.read(OP_COUNT_ITEM.name)


def load_recent_captures(inputs: Inputs) -> DataFrame:
    """Earlier captures are loaded from their directories, then what is new since then is looked for."""
    warehouse = Warehouse.scratch(inputs.spark)
    root = inputs.csv_lake().removesuffix("/*/*_*")
    snapshots.load_paths(warehouse, [f"{root}/*/*{EARLIER_DAYS}_*"], "*.csv")
    recent.load_recent(warehouse, root, "*.csv")
    return warehouse.read(OP_COUNT_ITEM.name)


def after_emptying(spark: SparkSession, data_dir: str, table: Table = COLLECTION_POLICY_LABELS) -> Warehouse:
    return emptied_warehouse(spark, data_dir, REWRITTEN_DAY, EMPTIED_HOSTS, table)


def _after_emptying(inputs: Inputs, table: Table) -> DataFrame:
    return after_emptying(inputs.spark, inputs.data_dir, table).read(table.name)


def warehouse_roundtrip_orc(inputs: Inputs) -> DataFrame:
    warehouse = Warehouse.scratch(inputs.spark, "orc")
    return warehouse.replace(OP_COUNT_ITEM.name, inputs.items)


def _numbered(inputs: Inputs, lake: str) -> DataFrame:
    return reports.numbered_lines(reports.staged_lines(inputs.spark, lake, file_name="*.txt"))


def clean_index_report(inputs: Inputs) -> DataFrame:
    return _numbered(inputs, inputs.report_lake()).select(*SNAPSHOT, "line_no", "line")


def parse_index_report(inputs: Inputs) -> DataFrame:
    return reports.parse_reports(inputs.spark, inputs.report_lake(), file_name="*.txt")


def _damaged_reports(inputs: Inputs) -> str:
    """Reports in which ops lines of counts ending in 9 are garbled and index lines of counts
    ending in 4 are missing."""
    ops = F.col("line").contains("ops: ")
    # Both lines of an item carry the last digit of its count.
    carried = {"digit": F.abs(F.col("UseCount")) % 10}
    lines = report_captures.report_lines(reportable(inputs.items), carried)
    damaged = lines.withColumn(
        "line", F.when((F.col("digit") == 9) & ops, "    node: ops: n/a").otherwise(F.col("line"))
    ).filter(ops | ~F.col("digit").eqNullSafe(F.lit(4)))
    root = scratch_folder(inputs.spark, "reports")
    return report_captures.write_reports(damaged, root, LINES_PER_ITEM * inputs.items.count())


def report_parse_errors(inputs: Inputs) -> DataFrame:
    lake = _damaged_reports(inputs)
    return reports.report_errors(_numbered(inputs, lake)).drop("file_path")


def load_errors(inputs: Inputs) -> DataFrame:
    """The same damaged reports as the loading job leaves them in the table of errors."""
    warehouse = Warehouse.scratch(inputs.spark)
    reports.load_reports(warehouse, _damaged_reports(inputs), file_name="*.txt")
    return warehouse.read(LOAD_ERRORS.name).drop("file_path", "LoadedAt")


def load_issues(inputs: Inputs) -> DataFrame:
    """Captures in which counts ending in 9 are no numbers, lines of counts ending in 4 have a field
    too many, and seconds of some days are out of range; what the loading job says of them."""
    digit = F.col("UseCount") % 10
    second = F.when(F.col(DAY) % 7 == 0, F.col(SECOND) % 10_000 + 90_000).otherwise(F.col(SECOND))
    lake = scratch_folder(inputs.spark, "csv")
    (
        inputs.items.select(
            COLLECTION,
            F.when(digit == 4, F.concat(INDEX, F.lit("|more"))).otherwise(F.col(INDEX)).alias(INDEX),
            F.when(digit == 9, "n/a").otherwise(F.col("UseCount").cast("string")).alias("UseCount"),
            F.concat(snapshots.utc_text(F.col("Since")), F.lit(" +0000 UTC")).alias("Since"),
            HOST,
            F.concat_ws("_", DAY, second).alias("snapshot"),
        )
        .write.partitionBy(HOST, "snapshot")
        .option("sep", "|").option("header", True).option("quote", "")
        .csv(lake)
    )
    warehouse = Warehouse.scratch(inputs.spark)
    snapshots.load_snapshots(warehouse, lake, file_name="*.csv")
    found = warehouse.read(LOAD_ISSUES.name)
    counts = ("CorruptCount", "OutOfRangeSecondCount", "NullUseCountCount", "NullSinceCount")
    return (
        found.select(*snapshot_path_columns(F.col("file_path")), *counts)
        .groupBy(*SNAPSHOT)
        .agg(*(F.sum(c).alias(c) for c in counts))
    )


# --- sinks -----------------------------------------------------------------------------------


def _shifted(df: DataFrame, condition: Column) -> DataFrame:
    return df.withColumn(
        "UseCount", F.when(condition, F.col("UseCount") + 7).otherwise(F.col("UseCount"))
    )


def overwrite_dynamic(inputs: Inputs) -> DataFrame:
    """Write all collection facts, then write the later days again with other counts."""
    warehouse = Warehouse.scratch(inputs.spark)
    stored_facts = warehouse.replace(COLLECTION_OPS_AGG.name, inputs.facts)
    later = F.col(DAY) >= REWRITTEN_DAY
    rewritten = stored(_shifted(stored_facts.filter(later), later), "rewritten")
    return warehouse.replace(COLLECTION_OPS_AGG.name, rewritten)


def overwrite_dynamic_host(inputs: Inputs) -> DataFrame:
    """The same on a table partitioned by host: one host's history is replaced as a whole."""
    warehouse = Warehouse.scratch(inputs.spark)
    name = COLLECTION_POLICY_LABELS.name
    stored_labels = warehouse.replace(name, inputs.policy())
    one_host = F.col(HOST) == REWRITTEN_HOST
    rewritten = stored(_shifted(stored_labels.filter(one_host), one_host), "rewritten")
    return warehouse.replace(name, rewritten)


# --- aggregates ------------------------------------------------------------------------------


def index_ops_agg_recompute(inputs: Inputs) -> DataFrame:
    return fact_ops.recompute_facts(inputs.items, Warehouse.scratch(inputs.spark))[1]


def _with_copies(table: DataFrame) -> DataFrame:
    """The table with a second copy of some rows, in one pass over it."""
    copied = (F.col(DAY) == COPIED_DAY) & (F.col("UseCount") > 0)
    copies = F.when(copied, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return table.withColumn("copy", F.explode(copies)).drop("copy")


def change_navigation(inputs: Inputs) -> DataFrame:
    return legacy.change_navigation(
        labels.discrete_history(inputs.facts, inputs.ranges, expected=inputs.expected)
    ).drop("UseCount")


def label_lookup(inputs: Inputs) -> DataFrame:
    return quality.label_lookup(inputs.stored(COLLECTION_DISCRETE_LABELS), *LOOKUP)


_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    # sources and sinks
    "load_snapshot_csv": load_snapshot_csv,
    "path_partition_columns": path_partition_columns,
    "reload_one_snapshot": reload_one_snapshot,
    "load_recent_captures": load_recent_captures,
    "reload_emptied_snapshot": lambda q: _after_emptying(q, OP_COUNT_ITEM),
    "facts_of_changed_captures": lambda q: _after_emptying(q, COLLECTION_OPS_AGG),
    "labels_of_changed_hosts": lambda q: _after_emptying(q, COLLECTION_POLICY_LABELS),
    "warehouse_roundtrip_orc": warehouse_roundtrip_orc,
    "clean_index_report": clean_index_report,
    "parse_index_report": parse_index_report,
    "report_parse_errors": report_parse_errors,
    "load_issues": load_issues,
    "load_errors": load_errors,
    "overwrite_dynamic": overwrite_dynamic,
    "overwrite_dynamic_host": overwrite_dynamic_host,
    # facts
    "op_count_item": lambda q: q.items,
    "collection_ops_agg": lambda q: q.facts,
    "index_ops_agg": lambda q: q.index_facts,
    "index_ops_agg_recompute": index_ops_agg_recompute,
    "known_collections": lambda q: fact_ops.known_collections(q.facts),
    "distinct_snapshots": lambda q: fact_ops.distinct_snapshots(q.stored(COLLECTION_OPS_AGG)),
    # timeline
    "partition_ranges": lambda q: timeline.partition_ranges(
        fact_ops.distinct_snapshots(q.stored(COLLECTION_OPS_AGG))
    ).drop("partition_count"),
    "partition_labels": lambda q: timeline.partition_labels(
        timeline.partition_ranges(fact_ops.distinct_snapshots(q.stored(COLLECTION_OPS_AGG)))
    ),
    # labels
    "collection_grid": lambda q: history.collection_grid(q.facts, q.ranges),
    "before_after_grid": lambda q: history.before_after_grid(q.facts, q.ranges, q.expected),
    "discrete_labels": lambda q: q.discrete(),
    "discrete_labels_v1": lambda q: q.discrete("v1"),
    "activity_policy_labels": lambda q: q.policy(),
    "activity_policy_labels_n7": lambda q: q.policy(7),
    "activity_policy_labels_n4": lambda q: q.policy(4),
    "activity_policy_labels_v1": lambda q: q.policy(rules="v1"),
    # reports
    "sankey_edges": lambda q: sankey.sankey_edges(q.transitions()),
    "sankey_rows": lambda q: sankey.sankey_rows(q.transitions()),
    "sankey_report": lambda q: sankey.sankey_report(q.transitions()),
    "sankey_report_ordered": lambda q: sankey.sankey_report_ordered(q.transitions()),
    # legacy
    "known_collections_legacy": lambda q: legacy.known_collections_legacy(q.items),
    "initial_future_date": lambda q: legacy.initial_future_date(q.items, q.ranges),
    "legacy_activity_labels": lambda q: q.legacy_labels(),
    "change_navigation": change_navigation,
    "basic_sankey": lambda q: legacy.basic_sankey(q.legacy_labels(), q.ranges),
    # checks
    "dup_items": lambda q: quality.duplicate_keys(_with_copies(q.items), quality.ITEM_KEY),
    "dup_collection_agg": lambda q: quality.duplicate_keys(
        _with_copies(q.facts), quality.COLLECTION_KEY
    ),
    "dup_index_agg": lambda q: quality.duplicate_keys(
        _with_copies(q.index_facts), quality.INDEX_KEY
    ),
    "snapshot_counts_items": lambda q: quality.snapshot_counts(q.items),
    "snapshot_counts_collections": lambda q: quality.snapshot_counts(q.facts),
    "snapshot_counts_indexes": lambda q: quality.snapshot_counts(q.index_facts),
    "instant_counts_items": lambda q: quality.instant_counts(q.items),
    "instant_counts_collections": lambda q: quality.instant_counts(q.facts),
    "label_counts": lambda q: quality.label_counts(
        q.stored(COLLECTION_DISCRETE_LABELS), LABEL_DAYS
    ),
    "label_counts_detailed": lambda q: quality.label_counts(
        q.stored(COLLECTION_POLICY_LABELS), LABEL_DAYS, "CollectionUseStatus", "ActivityPolicyStatus"
    ),
    "label_lookup": label_lookup,
    "startup_dates": lambda q: quality.startup_dates(q.items, q.ranges),
    "cohort_overlap": lambda q: quality.cohort_overlap(q.facts, *COHORT_DAYS),
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, data_dir: query(Inputs(spark, data_dir))

    return {name: bind(query) for name, query in _QUERIES.items()}
