"""Shape of the physical plans: what is shuffled, read and broadcast."""

from __future__ import annotations

import re

import pytest

from tallyline.operators import sankey
from tallyline.operators.facts import collection_facts, index_facts
from tallyline.plans import jobs
from tallyline.plans.catalog import Inputs, registered
from tallyline.sources.warehouse import Warehouse
from tests.conftest import SAMPLE


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> list[str]:
    """Keys of the shuffles, top down, without the candidates for pruning the timeline scan: those
    run only where the plan broadcasts them anyway."""
    plan = plan.split("SubqueryAdaptiveBroadcast")[0]
    return [
        re.sub(r"#\d+L?", "", found)
        for found in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    ]


def reads(df) -> set[str]:
    """The tables of a warehouse that a query reads."""
    return {re.search(r"/(\w+)/mongo_hostname=", path)[1] for path in df.inputFiles()}


# Queries that write and read back; their plans are scans.
WRITING = {
    "load_snapshot_csv", "path_partition_columns", "reload_one_snapshot", "warehouse_roundtrip_orc",
    "clean_index_report", "parse_index_report", "report_parse_errors", "overwrite_dynamic",
    "overwrite_dynamic_host", "index_ops_agg_recompute", "load_issues", "load_errors", "load_recent_captures",
    "reload_emptied_snapshot", "facts_of_changed_captures", "labels_of_changed_hosts",
}
SERIES = "mongo_hostname, CollectionName"
FACT_KEY = "mongo_hostname, days_post_epoch, seconds_of_day, CollectionName"


@pytest.mark.parametrize(
    "name", ["discrete_labels", "activity_policy_labels", "before_after_grid", "change_navigation"]
)
def test_labels_shuffle_facts_once(spark, name):
    """Facts are built, then moved once to their series; every window finds them there."""
    assert exchanges(plan_of(registered()[name](spark, SAMPLE))) == [SERIES, FACT_KEY]


RUN_KEY = "mongo_hostname, PartitionRank, Before, After, UntilRank, Gone, FromRank, Awaited"


def test_sankey_counts_facts_without_the_grid(spark):
    """Facts go to their series and nothing is made of them but counts of like ones."""
    source = Inputs(spark, SAMPLE)
    plan = plan_of(sankey.fact_runs(source.facts, source.ranges))
    assert exchanges(plan) == [RUN_KEY, SERIES, FACT_KEY] and "Generate" not in plan
    assert "ReadSchema: struct<CollectionName:string,UseCount:bigint>" in plan
    plan = plan_of(registered()["sankey_edges"](spark, SAMPLE))
    assert "Generate" not in plan and "CollectionName" not in plan


def test_scans_read_only_what_is_needed(spark):
    counts = plan_of(registered()["snapshot_counts_items"](spark, SAMPLE))
    assert "ReadSchema: struct<>" in counts


def test_partitions_are_pruned(spark):
    plan = plan_of(registered()["cohort_overlap"](spark, SAMPLE))
    assert re.search(r"PartitionFilters: \[.*days_post_epoch#\d+ IN \(19725,19750\)", plan)
    for name in ("label_counts", "label_lookup"):
        plan = plan_of(registered()[name](spark, SAMPLE))
        assert re.search(r"PartitionFilters: \[.*days_post_epoch#\d+", plan) and "Exchange hash" not in plan.split("HashAggregate")[-1]
    assert reads(registered()["distinct_snapshots"](spark, SAMPLE)) == {"collectionOpsAgg"}


@pytest.mark.parametrize("name", ["initial_future_date", "startup_dates"])
def test_only_first_snapshots_are_read_even_without_broadcast(spark, setting, name):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(registered()[name](spark, SAMPLE))
    items = [scan for scan in re.findall(r"FileScan parquet .*", plan) if re.search(r"\bSince:timestamp", scan)]
    assert items and all(re.search(r"PartitionFilters: \[.*concat_ws", scan) for scan in items)


def test_jobs_make_the_grid_once(spark, tmp_path):
    """Labels, policy and transitions come from the facts, not from a stored grid."""
    warehouse = Warehouse(spark, str(tmp_path / "parquet"))
    source = Inputs(spark, SAMPLE)
    warehouse.write("opCountItem", source.items.filter("days_post_epoch < 19727"))
    jobs.run_all(warehouse)
    runs = sankey.fact_runs(warehouse.read("collectionOpsAgg"), warehouse.read("partitionRanges"))
    assert reads(runs) == {"collectionOpsAgg", "partitionRanges"}
    assert exchanges(plan_of(runs)) == [RUN_KEY, SERIES]
    assert jobs.transitions(warehouse).count() > 0


def test_no_python_and_no_cross_joins(spark):
    for name, query in registered().items():
        if name in WRITING:
            continue
        plan = plan_of(query(spark, SAMPLE))
        assert not re.search(r"CartesianProduct|BroadcastNestedLoop|ArrowEval|BatchEvalPython", plan)


def test_inputs_are_shared_within_a_session(spark):
    first, second = Inputs(spark, SAMPLE), Inputs(spark, SAMPLE)
    assert first.items.inputFiles() == second.items.inputFiles()


def test_collection_with_very_many_indexes_is_split(spark, setting):
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }.items():
        setting(key, value)
    # Collection 0 holds half of all items.
    collection = "if(id % 2 = 0, 'c0', concat('c', id % 1000))"
    items = spark.range(0, 40000, 1, 8).selectExpr(
        f"{collection} AS CollectionName", "concat('i', id) AS IndexName", "id % 3 AS UseCount",
        "'h' AS mongo_hostname", "1 AS days_post_epoch", "1 AS seconds_of_day",
    )
    df = index_facts(items, collection_facts(items))
    assert df.filter("LoadedInCollectionCount = 1").count() > 0
    rows = df.collect()
    assert len(rows) == 40000
    assert "isSkew=true" in plan_of(df) or "skew=true" in plan_of(df)
