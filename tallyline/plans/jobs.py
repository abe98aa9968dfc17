"""The steps from captures to Sankey edges, each reading and writing warehouse tables.

Every step starts from stored tables, so a failed run resumes at its step, a lost executor costs
a re-read, and the planner knows the size of the timeline before it joins it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators.facts import collection_facts, distinct_snapshots, index_facts
from tallyline.operators.labels import (
    DEFAULT_INACTIVITY,
    activity_policy_labels,
    discrete_labels,
    policy_labels_of,
)
from tallyline.operators.legacy import basic_sankey, dated_ranges, legacy_activity_labels
from tallyline.operators.sankey import sankey_report, transitions_of_facts, write_report
from tallyline.operators.timeline import partition_ranges
from tallyline.schema import (
    BASIC_SANKEY,
    COLLECTION,
    COLLECTION_DISCRETE_LABELS,
    COLLECTION_OPS_AGG,
    COLLECTION_POLICY_LABELS,
    HOST,
    INDEX_OPS_AGG,
    LEGACY_ACTIVITY_LABELS,
    OP_COUNT_ITEM,
    PARTITION_RANGES,
    Table,
)
from tallyline.sources import manifest, publications, reports
from tallyline.sources.recent import load_recent
from tallyline.sources.reports import DEFAULT_DB
from tallyline.sources.scratch import stored, temporary
from tallyline.sources.snapshots import lake_glob, load_snapshots
from tallyline.sources.warehouse import Warehouse


def load_csv(warehouse: Warehouse, lake_root: str, host: str = "*") -> None:
    load_snapshots(warehouse, lake_root, host)


def load_new(warehouse: Warehouse, lake_root: str) -> None:
    """Captures of new hosts, and of known ones from their last day on."""
    load_recent(warehouse, lake_root)


def load_reports(warehouse: Warehouse, lake_root: str, db_name: str = DEFAULT_DB) -> None:
    """Raw reports straight into the item table, with the issues and errors found in them."""
    reports.load_reports(warehouse, lake_glob(lake_root), db_name)


def derive_collection_facts(warehouse: Warehouse, captures: DataFrame | None = None) -> None:
    """Facts of the items, or of chosen captures only; captures without items have no facts."""
    items = warehouse.read(OP_COUNT_ITEM.name)
    _rederive(warehouse, COLLECTION_OPS_AGG, captures, items, collection_facts)


def derive_index_facts(warehouse: Warehouse, captures: DataFrame | None = None) -> None:
    items, facts = warehouse.read(OP_COUNT_ITEM.name), warehouse.read(COLLECTION_OPS_AGG.name)
    if captures is not None:
        facts = only(facts, captures)
    _rederive(warehouse, INDEX_OPS_AGG, captures, items, lambda rows: index_facts(rows, facts))


def derive_timeline(warehouse: Warehouse, hosts: DataFrame | None = None) -> None:
    """Snapshots come from the collection facts: the smallest table that has them all."""
    facts = warehouse.read(COLLECTION_OPS_AGG.name)
    _rederive(
        warehouse, PARTITION_RANGES, hosts, facts, lambda rows: partition_ranges(distinct_snapshots(rows))
    )


def _rederive(
    warehouse: Warehouse,
    table: Table,
    chosen: DataFrame | None,
    source: DataFrame,
    derive: Callable[[DataFrame], DataFrame],
) -> None:
    """Write what follows from the chosen partitions of the source (all unless told), and remove the
    partitions of the table that nothing follows for any more."""
    rows = source if chosen is None else only(source, chosen)
    warehouse.write(table.name, derive(rows))
    held = warehouse.partitions(table.name)
    held = held if chosen is None else held.join(chosen, chosen.columns, "left_semi")
    there = rows.filter(F.col(COLLECTION).isNotNull()) if table is PARTITION_RANGES else rows
    gone = held.join(there.select(*table.partition_by).distinct(), table.partition_by, "left_anti")
    warehouse.drop(table.name, gone)


# Up to so many chosen partitions are listed in a filter.
LISTED = 1000


def only(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen partitions. A few of them are listed in a filter on the partition columns,
    so that nothing else is read; of many, the join decides."""
    keys = chosen.columns
    listed = chosen.limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        return rows.filter(F.concat_ws("/", *keys).isin(["/".join(map(str, row)) for row in listed]))
    return rows.join(chosen, keys, "left_semi")


# The labels that follow from so many facts make a piece of each host.
PIECE_FACTS = 1 << 20


def label_collections(warehouse: Warehouse, rules: str = "current") -> None:
    facts, ranges = (warehouse.read(t.name) for t in (COLLECTION_OPS_AGG, PARTITION_RANGES))
    warehouse.write(COLLECTION_DISCRETE_LABELS.name, discrete_labels(facts, ranges, rules, facts.count()))


def apply_policy(
    warehouse: Warehouse, n_inactivity: int = DEFAULT_INACTIVITY, rules: str = "current"
) -> None:
    labels = warehouse.read(COLLECTION_DISCRETE_LABELS.name)
    warehouse.write(
        COLLECTION_POLICY_LABELS.name, activity_policy_labels(labels, n_inactivity, rules)
    )


def label_all(
    warehouse: Warehouse,
    n_inactivity: int = DEFAULT_INACTIVITY,
    rules: str = "current",
    hosts: DataFrame | None = None,
    through: int | None = None,
) -> DataFrame:
    """Both label tables in one pass from the facts: the grid is made once, in place, and the policy
    table has all columns of the other, which only has to be laid out by snapshot. They are
    published together, for all hosts or for chosen ones; ``through`` is the last load covered."""
    facts, ranges = (warehouse.read(t.name) for t in (COLLECTION_OPS_AGG, PARTITION_RANGES))
    if hosts is not None:
        facts, ranges = only(facts, hosts), only(ranges, hosts)
    generation, expected = publications.Generation(warehouse), facts.count()
    policy = generation.write(
        COLLECTION_POLICY_LABELS.name,
        policy_labels_of(facts, ranges, n_inactivity, rules, expected),
        1 + expected // PIECE_FACTS,
    )
    generation.write(COLLECTION_DISCRETE_LABELS.name, policy)
    generation.publish(hosts, _policy(n_inactivity, rules), through)
    return warehouse.read(COLLECTION_POLICY_LABELS.name)


def _policy(n_inactivity: int, rules: str) -> str:
    return f"{rules} {n_inactivity}"


def transitions(warehouse: Warehouse, n_inactivity: int = DEFAULT_INACTIVITY) -> DataFrame:
    """Counted transitions, from the facts: the grid of collections and snapshots is not made."""
    facts, ranges = (warehouse.read(t.name) for t in (COLLECTION_OPS_AGG, PARTITION_RANGES))
    return transitions_of_facts(facts, ranges, n_inactivity)


def report_transitions(warehouse: Warehouse, path: str, n_inactivity: int = DEFAULT_INACTIVITY) -> None:
    with temporary(warehouse.spark):
        write_report(sankey_report(transitions(warehouse, n_inactivity)), path)


def run_all(
    warehouse: Warehouse, n_inactivity: int = DEFAULT_INACTIVITY, rules: str = "current"
) -> DataFrame:
    """Everything after loading, in dependency order; returns the policy labels. Captures and hosts
    that the items no longer have go from every table."""
    through = manifest.last_load(warehouse)
    derive_collection_facts(warehouse)
    derive_index_facts(warehouse)
    derive_timeline(warehouse)
    return label_all(warehouse, n_inactivity, rules, through=through)


def run_changed(
    warehouse: Warehouse, n_inactivity: int = DEFAULT_INACTIVITY, rules: str = "current"
) -> DataFrame:
    """The same result as :func:`run_all`, at the cost of what was loaded since the last run.

    The manifest tells which captures the loads have touched. Facts are made anew for these only,
    timeline and labels for their hosts, whose labels look back and ahead over the whole history.
    Files of other hosts stay as they are. Without an earlier run under the same policy, or after
    one that covers no load, everything is run. Items written past the loads are not seen here.
    """
    policy, covered = publications.last_run(warehouse, COLLECTION_POLICY_LABELS.name)
    if policy != _policy(n_inactivity, rules) or not covered:
        return run_all(warehouse, n_inactivity, rules)
    through = manifest.last_load(warehouse)
    if through == covered:
        return warehouse.read(COLLECTION_POLICY_LABELS.name)
    with temporary(warehouse.spark):
        captures = stored(manifest.touched_since(warehouse, covered), "changed-captures")
        hosts = stored(captures.select(HOST).distinct(), "changed-hosts")
        derive_collection_facts(warehouse, captures)
        derive_index_facts(warehouse, captures)
        derive_timeline(warehouse, hosts)
        return label_all(warehouse, n_inactivity, rules, hosts, through)


def label_legacy(warehouse: Warehouse) -> None:
    """The legacy label table and its Sankey counts."""
    items, ranges = (warehouse.read(t.name) for t in (OP_COUNT_ITEM, PARTITION_RANGES))
    with temporary(warehouse.spark):
        dated = stored(dated_ranges(items, ranges), "dated-ranges")
        labels = warehouse.replace(LEGACY_ACTIVITY_LABELS.name, legacy_activity_labels(items, dated))
        warehouse.write(BASIC_SANKEY.name, basic_sankey(labels, ranges))
