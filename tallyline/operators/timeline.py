"""The snapshots of each host in order, with distances to their neighbours and to both ends.

A host may have very many snapshots, so nothing here windows over all of them. A day number has
five digits and a second at most five, hence a (host) window over *days* and a (host, day) window
over *snapshots* each see at most 100,000 rows; what lies outside a day comes from the days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions.clock import elapsed, event_text
from tallyline.schema import DAY, HOST, PARTITION_RANGES, SECOND, SNAPSHOT


def _count(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _days(snapshots: DataFrame) -> DataFrame:
    """One row per host and day: its place in the host's history and its neighbouring days."""
    by_day = Window.partitionBy(HOST).orderBy(DAY)
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = (
        snapshots.groupBy(HOST, DAY)
        .agg(F.count("*").alias("size"), F.min(SECOND).alias("lo"), F.max(SECOND).alias("hi"))
        .select(
            HOST,
            DAY,
            "size",
            "lo",
            "hi",
            F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("rank_before"),
            F.sum("size").over(whole).alias("partition_count"),
            F.lag(DAY).over(by_day).alias("prior_day"),
            F.lag("hi").over(by_day).alias("prior_day_hi"),
            F.lead(DAY).over(by_day).alias("next_day"),
            F.lead("lo").over(by_day).alias("next_day_lo"),
            F.first(DAY).over(whole).alias("first_days_post"),
            F.first("lo").over(whole).alias("first_seconds_of"),
            F.last(DAY).over(whole).alias("last_days_post"),
            F.last("hi").over(whole).alias("last_seconds_of"),
        )
    )

    # Elapsed-day labels in use. From the first snapshot on, elapsed day k covers the late part of
    # calendar day k (second >= first second) and the early part of day k + 1; it is counted at its
    # late part, or at its early part if there is no late one. From the end it is the mirror image.
    after_first = F.col("hi") >= F.col("first_seconds_of")
    before_first = F.col("lo") < F.col("first_seconds_of")
    prior_counted = (F.col("prior_day") == F.col(DAY) - 1) & (
        F.col("prior_day_hi") >= F.col("first_seconds_of")
    )
    until_last = F.col("lo") <= F.col("last_seconds_of")
    past_last = F.col("hi") > F.col("last_seconds_of")
    next_counted = (F.col("next_day") == F.col(DAY) + 1) & (
        F.col("next_day_lo") <= F.col("last_seconds_of")
    )
    rising = _count(after_first) + _count(before_first & ~F.coalesce(prior_counted, F.lit(False)))
    falling = _count(until_last) + _count(past_last & ~F.coalesce(next_counted, F.lit(False)))

    # A label shared by m snapshots causes m - 1 conflicts, so conflicts = snapshots - labels.
    # Calendar-day labels conflict equally often from both ends.
    def conflicts(labels: Column) -> Column:
        return F.sum(F.col("size") - labels).over(whole)

    return (
        placed.withColumn("absolute_conflicts", conflicts(F.lit(1)))
        .withColumn("rising_conflicts", conflicts(rising))
        .withColumn("falling_conflicts", conflicts(falling))
    )


def _label(day: Column, sequence: Column) -> Column:
    text = day.cast("string")
    return F.when(sequence == 1, text).otherwise(F.concat(text, F.lit("_"), sequence.cast("string")))


def partition_ranges(snapshots: DataFrame) -> DataFrame:
    """The timeline table, from distinct (host, day, second) rows.

    The rows are used twice. Filtering incomplete keys up front gives both uses the same plan, so
    their shuffle, and the scan below it, run once.
    """
    complete = F.col(HOST).isNotNull() & F.col(DAY).isNotNull() & F.col(SECOND).isNotNull()
    snapshots = snapshots.select(*SNAPSHOT).filter(complete)
    in_day = Window.partitionBy(HOST, DAY).orderBy(SECOND)
    day, second = F.col(DAY), F.col(SECOND)

    placed = (
        snapshots.join(_days(snapshots), [HOST, DAY])
        .withColumn("row", F.row_number().over(in_day))
        .withColumn("lag_second", F.lag(SECOND).over(in_day))
        .withColumn("lead_second", F.lead(SECOND).over(in_day))
    )
    first_in_day, last_in_day = F.col("lag_second").isNull(), F.col("lead_second").isNull()
    navigated = (
        placed.withColumn("partition_rank", (F.col("rank_before") + F.col("row")).cast("int"))
        .withColumn("prior_days_post", F.when(first_in_day, F.col("prior_day")).otherwise(day))
        .withColumn("prior_seconds_of", F.coalesce("lag_second", "prior_day_hi"))
        .withColumn("next_days_post", F.when(last_in_day, F.col("next_day")).otherwise(day))
        .withColumn("next_seconds_of", F.coalesce("lead_second", "next_day_lo"))
    )

    spans = {
        "since_first": ("first_days_post", "first_seconds_of", DAY, SECOND),
        "until_last": (DAY, SECOND, "last_days_post", "last_seconds_of"),
        "since_prior": ("prior_days_post", "prior_seconds_of", DAY, SECOND),
        "until_next": (DAY, SECOND, "next_days_post", "next_seconds_of"),
    }
    columns: dict[str, Column] = {}
    for name, ends in spans.items():
        days, seconds = elapsed(*(F.col(end) for end in ends))
        columns[f"{name}_days_post"], columns[f"{name}_seconds_of"] = days, seconds
    measured = navigated.withColumns(columns)

    # An elapsed day touches two calendar days, so these groups are as bounded as a day is.
    rising = Window.partitionBy(HOST, "since_first_days_post").orderBy(F.col("partition_rank"))
    falling = Window.partitionBy(HOST, "until_last_days_post").orderBy(F.desc("partition_rank"))
    sequenced = measured.withColumn("rising_seq", F.row_number().over(rising)).withColumn(
        "falling_seq", F.row_number().over(falling)
    )

    ascending = F.when(
        F.col("rising_conflicts") <= F.col("absolute_conflicts"),
        _label(F.col("since_first_days_post"), F.col("rising_seq")),
    ).otherwise(_label(day - F.col("first_days_post"), F.col("row")))
    descending = F.when(
        F.col("falling_conflicts") <= F.col("absolute_conflicts"),
        _label(F.col("until_last_days_post"), F.col("falling_seq")),
    ).otherwise(_label(F.col("last_days_post") - day, F.col("size") - F.col("row") + 1))

    return sequenced.withColumns(
        {
            "this_event_at": event_text(day, second),
            **{
                f"{end}_event_at": event_text(f"{end}_days_post", f"{end}_seconds_of")
                for end in ("prior", "next", "first", "last")
            },
            "is_first_partition": F.col("prior_days_post").isNull(),
            "is_last_partition": F.col("next_days_post").isNull(),
            "ascending_label": ascending,
            "descending_label": descending,
        }
    ).select(*(F.col(f.name).cast(f.dataType) for f in PARTITION_RANGES.schema))


def partition_labels(ranges: DataFrame) -> DataFrame:
    return ranges.select(HOST, "partition_rank", "ascending_label", "descending_label")
