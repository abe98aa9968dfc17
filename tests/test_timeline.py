"""The timeline against a direct computation on small histories."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timezone

import pytest

from tallyline.operators.facts import distinct_snapshots
from tallyline.operators.timeline import partition_ranges

DAY = 86400


def label_column(keys: list[int]) -> tuple[list[str], int]:
    seen: Counter = Counter()
    labels = []
    for key in keys:
        seen[key] += 1
        labels.append(str(key) if seen[key] == 1 else f"{key}_{seen[key]}")
    return labels, len(keys) - len(seen)


def chosen(relative: list[int], absolute: list[int]) -> list[str]:
    rel, rel_conflicts = label_column(relative)
    abs_, abs_conflicts = label_column(absolute)
    return rel if rel_conflicts <= abs_conflicts else abs_


def expected_labels(snapshots: list[tuple[int, int]]) -> list[tuple[str, str]]:
    times = sorted(d * DAY + s for d, s in snapshots)
    first, last = times[0], times[-1]
    rising = chosen([(t - first) // DAY for t in times], [t // DAY - first // DAY for t in times])
    back = times[::-1]
    falling = chosen([(last - t) // DAY for t in back], [last // DAY - t // DAY for t in back])
    return list(zip(rising, falling[::-1]))


def ranges_of(spark, hosts: dict[str, list[tuple[int, int]]]):
    rows = [(host, d, s) for host, snapshots in hosts.items() for d, s in snapshots]
    df = spark.createDataFrame(
        rows, "mongo_hostname string, days_post_epoch int, seconds_of_day int"
    )
    result: dict[str, list] = {}
    for row in partition_ranges(df).orderBy("mongo_hostname", "partition_rank").collect():
        result.setdefault(row.mongo_hostname, []).append(row)
    return result


def test_against_direct_computation(spark):
    pick = random.Random(7)
    hosts = {}
    for number in range(40):
        size = pick.choice([1, 2, 3, 8, 20])
        span = pick.choice([1, 3, 10, 40])
        seconds = pick.choice([[3600], [0, 86399], list(range(0, DAY, 3601))])
        hosts[f"h{number}"] = sorted(
            {(25000 + pick.randrange(span), pick.choice(seconds)) for _ in range(size)}
        )
    hosts["steady"] = [(24850 + d, 3600) for d in range(20)]
    got = ranges_of(spark, hosts)
    for host, snapshots in hosts.items():
        rows, times = got[host], [d * DAY + s for d, s in snapshots]
        assert [r.partition_rank for r in rows] == list(range(1, len(times) + 1))
        assert [(r.days_post_epoch, r.seconds_of_day) for r in rows] == snapshots
        assert [(r.ascending_label, r.descending_label) for r in rows] == expected_labels(snapshots)
        for i, row in enumerate(rows):
            ends = {
                ("first", "since_first"): times[i] - times[0],
                ("last", "until_last"): times[-1] - times[i],
                ("prior", "since_prior"): times[i] - times[i - 1] if i else None,
                ("next", "until_next"): times[i + 1] - times[i] if i + 1 < len(times) else None,
            }
            for (end, span), gap in ends.items():
                got_gap = (row[f"{span}_days_post"], row[f"{span}_seconds_of"])
                assert got_gap == ((None, None) if gap is None else divmod(gap, DAY))
                assert (row[f"{end}_event_at"] is None) == (gap is None)
            assert row.is_first_partition == (i == 0)
            assert row.is_last_partition == (i == len(times) - 1)


def test_absolute_label_with_suffix(spark):
    """More conflicts by elapsed day than by calendar day, but some by calendar day too."""
    snapshots = [(20000, 80000), (20001, 79000), (20002, 1000), (20002, 2000), (20002, 79000)]
    rows = ranges_of(spark, {"h": snapshots})["h"]
    assert [r.ascending_label for r in rows] == ["0", "1", "2", "2_2", "2_3"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_texts_are_utc_and_survive_2038(spark, setting, zone):
    setting("spark.sql.session.timeZone", zone)
    rows = ranges_of(spark, {"h": [(19791, 9000), (25000, 59)]})["h"]
    for row in rows:
        at = datetime.fromtimestamp(row.days_post_epoch * DAY + row.seconds_of_day, timezone.utc)
        assert row.this_event_at == at.strftime("%Y-%m-%d %H:%M:%S")


def test_unnamed_collections_make_no_snapshot(spark):
    df = spark.createDataFrame(
        [("h", 1, 1, "c"), ("h", 1, 1, None), ("h", 2, 1, None)],
        "mongo_hostname string, days_post_epoch int, seconds_of_day int, CollectionName string",
    )
    assert distinct_snapshots(df).count() == 1
