"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every query is built and
run to its last row into a sink that discards it. Queries that take under ``REPEAT_UNDER`` seconds
run three times and give their median. ``prepare`` is the mapping of events to the stored item and
timeline tables that the queries start from; ``prepare_csv`` and ``prepare_reports`` write the capture
files that the loading queries share, ``prepare_labels`` the stored labels that checks look at, and
``prepare_emptied`` a load, a full run, a reload and a partial run. All count towards the total.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import SparkSession

from tallyline.plans.catalog import after_emptying, registered
from tallyline.plans.prepared import csv_lake, event_warehouse, labelled_warehouse, report_lake
from tallyline.sources.scratch import release

REPEAT_UNDER = 5.0


def timed(run: Callable[[], object]) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    data_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # Local data is far below the cluster-sized floor for merging shuffle partitions, which
        # would leave most cores idle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executor threads and the code generator outside the timings.
    spark.range(1000).selectExpr("sum(id)").collect()

    seconds: dict[str, float] = {}
    prepared = {
        "prepare": event_warehouse, "prepare_csv": csv_lake, "prepare_reports": report_lake,
        "prepare_labels": labelled_warehouse, "prepare_emptied": after_emptying,
    }
    for name, prepare in prepared.items():
        seconds[name] = round(timed(lambda: prepare(spark, data_dir)), 3)

    for name, query in registered().items():
        if wanted and name not in wanted:
            continue

        def run() -> None:
            query(spark, data_dir).write.format("noop").mode("overwrite").save()

        runs = [timed(run)]
        while runs[0] < REPEAT_UNDER and len(runs) < 3:
            runs.append(timed(run))
        seconds[name] = round(median(runs), 3)

    print(
        json.dumps(
            {
                "metric": "usage_history_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": data_dir.rsplit("/sf", 1)[-1],
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
