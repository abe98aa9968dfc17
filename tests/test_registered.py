"""Every registered query against its SQL, on the smallest data set."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from oracle.statements import statements
from tests.compare import difference, duck
from tallyline.plans.catalog import registered
from tests.conftest import SAMPLE

QUERIES = registered()
STATEMENTS = statements()


@pytest.fixture(scope="module")
def connection():
    return duck(SAMPLE)


def test_every_query_has_a_statement():
    assert QUERIES.keys() == STATEMENTS.keys()
    assert QUERIES.keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    assert difference(QUERIES[name](spark, SAMPLE), connection, STATEMENTS[name]) is None


@pytest.mark.parametrize(
    "name",
    [
        "collection_grid", "before_after_grid", "activity_policy_labels",
        "legacy_activity_labels", "initial_future_date", "startup_dates",
    ],
)
def test_without_broadcast(spark, connection, setting, name):
    """A timeline too large to broadcast is joined by shuffling, with the same result."""
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    df = QUERIES[name](spark, SAMPLE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    # Only a horizon per host is grouped by host alone, from sums made before the shuffle.
    assert name == "initial_future_date" or not re.search(r"hashpartitioning\(mongo_hostname#\d+, \d+\)", plan)
    assert difference(df, connection, STATEMENTS[name]) is None


def test_edges_without_broadcast(spark, connection, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    assert difference(QUERIES["sankey_edges"](spark, SAMPLE), connection, STATEMENTS["sankey_edges"]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["mongo_hostname", "StateBefore", "StateAfter", "EdgeCount"]
    rows = df.collect()
    assert len(rows) == 535
    assert sum(row.EdgeCount for row in rows) == 2052
