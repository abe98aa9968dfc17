"""Status vocabularies and the rules that assign them, as Column expressions.

The rules read four facts about a collection at one snapshot:

* ``use``      cumulative counter now, NULL when the collection is absent
* ``before``   counter at the previous snapshot in which it was present
* ``created``  it first appeared after the first snapshot of its host
* ``purged``   it is absent now although it was present earlier
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The discrete use statuses, then the policy statuses.
USE_STATUSES = (
    "NotCreated", "Current", "Forgotten", "Deleted",
    "NotLoaded", "Accessed", "Ignored", "Removed",
    "ERROR",
)
POLICY_STATUSES = (
    "NotCreated", "NotLoaded", "Active", "Idle", "Restorable", "Inactive", "Deleted", "ERROR",
)

IN_USE = ("Current", "Accessed")
UNUSED = ("Forgotten", "Ignored")


def _absent(created: Column, purged: Column) -> Column:
    """Status of a collection that is missing from the snapshot; the same under all rule sets."""
    return (
        F.when(created & purged, "Deleted")
        .when(created, "NotCreated")
        .when(purged, "Removed")
        .otherwise("ERROR")
    )


def current_rules(use: Column, before: Column, created: Column, purged: Column) -> Column:
    """Canonical rules. A counter that goes backwards is ERROR, unless it is a pre-existing
    collection falling back to zero; so is a pre-existing collection first seen with use > 0."""
    late = (
        F.when(before.isNull() | (before < use), "Current")
        .when(before == use, "Forgotten")
        .otherwise("ERROR")
    )
    early = (
        F.when(use == 0, "NotLoaded")
        .when(before < use, "Accessed")
        .when((before == use) & (use > 0), "Ignored")
        .otherwise("ERROR")
    )
    return F.when(use.isNull(), _absent(created, purged)).when(created, late).otherwise(early)


def v1_rules(use: Column, before: Column, created: Column, purged: Column) -> Column:
    """Earlier rules: first sight with use > 0 counts as Accessed, and Forgotten needs a
    counter above zero, so a created collection that stays at zero is ERROR."""
    unchanged = (before == use) & (before > 0)
    late = (
        F.when(before.isNull() | (before < use), "Current")
        .when(unchanged, "Forgotten")
        .otherwise("ERROR")
    )
    early = (
        F.when(use == 0, "NotLoaded")
        .when(before.isNull() | (before < use), "Accessed")
        .when(unchanged, "Ignored")
        .otherwise("ERROR")
    )
    # A row that is present with a NULL counter keeps its ``before`` and is then not NotCreated.
    gone = F.when(created & ~purged & before.isNotNull(), "ERROR").otherwise(
        _absent(created, purged)
    )
    return F.when(use.isNull(), gone).when(created, late).otherwise(early)


RULES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "current": current_rules,
    "v1": v1_rules,
}


def in_use(status: Column) -> Column:
    return status.isin(*IN_USE)


def policy_status(status: Column, recently_active: Column, active_later: Column) -> Column:
    """Policy status from the discrete status and what surrounds it in time."""
    unused = (
        F.when(recently_active, "Idle").when(active_later, "Restorable").otherwise("Inactive")
    )
    return (
        F.when(status.isin("NotCreated", "NotLoaded", "Deleted"), status)
        .when(status == "Removed", "Deleted")
        .when(in_use(status), "Active")
        .when(status.isin(*UNUSED), unused)
        .otherwise("ERROR")
    )
