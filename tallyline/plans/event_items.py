"""An item table derived from an event log (columns event_id, ts, user_id, event_type, value, props).

Each (user, event type) stands for a collection with two indexes, each user for one of three
hosts, each host is captured on its own schedule, and events of high value are uses of an index.
``FIXTURES.md`` gives the rules; this is their declarative form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions.clock import SECONDS_PER_DAY, event_epoch
from tallyline.schema import COLLECTION, DAY, HOST, INDEX, OP_COUNT_ITEM, SECOND

# Fixed values of the mapping.
RESET_DAY = 19743
USAGE_VALUE = 80
GAP_DAYS = (19733, 19735)
DROP_DAY = 19738


def _second_of_day(host: Column, day: Column) -> Column:
    """Regular capture second of a host on a day."""
    return (
        F.when(host == 1, 36000)
        .when(host == 2, (day * 7919) % SECONDS_PER_DAY)
        .otherwise(3600)
    )


_EXTRA_SECOND = 82800


def _has_extra(host: Column, day: Column) -> Column:
    return (host == 3) & (day % 5 == 0)


def _seconds(host: Column, day: Column) -> Column:
    """Array of the seconds at which a host is captured on a day."""
    regular = _second_of_day(host, day).cast("int")
    return F.when(_has_extra(host, day), F.array(regular, F.lit(_EXTRA_SECOND))).otherwise(F.array(regular))


def op_count_items(events: DataFrame) -> DataFrame:
    """The item table, with captures from the day of the first event to that of the last. Shuffles grow
    with the events and collections; collections times captures are made last, in place. The only
    per-group state is one series of uses per index."""
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    log = events.select(
        F.col("user_id").alias("u"),
        F.col("event_type").alias("e"),
        "value",
        epoch.alias("t"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
        (F.col("user_id") % 3 + 1).cast("int").alias("h"),
    )
    ends = log.agg(F.min("t").alias("first"), F.max("t").alias("last")).first()
    first_day, last_day = ((t or 0) // SECONDS_PER_DAY for t in (ends.first, ends.last))
    return _items(_collections(log), _uses(log, first_day, last_day), first_day, last_day)


def _collections(log: DataFrame) -> DataFrame:
    return log.groupBy("u", "e", "h").agg(F.min("t").alias("ft"))


def _uses(log: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """Uses per index and first capture at or after them."""
    used = log.filter(F.col("value") >= USAGE_VALUE).withColumn(
        "d", F.floor(F.col("t") / SECONDS_PER_DAY).cast("int")
    )
    h, d = F.col("h"), F.col("d")
    second = F.col("t") - event_epoch("d", F.lit(0))
    capture_day = (
        F.when(second <= _second_of_day(h, d), d)
        .when(_has_extra(h, d) & (second <= _EXTRA_SECOND), d)
        .otherwise(d + 1)
    )
    capture_second = F.when(
        (F.col(DAY) == d) & (second > _second_of_day(h, d)), _EXTRA_SECOND
    ).otherwise(_second_of_day(h, F.col(DAY)))
    resets = F.col("u") % 11 == 0
    # A use from before a counter reset is gone from captures after it.
    lost = resets & (F.col(DAY) >= RESET_DAY) & (F.col("t") < RESET_DAY * SECONDS_PER_DAY)
    return (
        used.withColumn(DAY, F.greatest(capture_day, F.lit(first_day)).cast("int"))
        .withColumn(SECOND, capture_second.cast("int"))
        .filter((F.col(DAY) <= last_day) & ~lost)
        .withColumn(INDEX, F.when(F.col("k") >= 50, "k_hi").otherwise("k_lo"))
        .groupBy("u", "e", INDEX, DAY, SECOND)
        .agg(F.count("*").alias("uses"))
    )


def _starts(collections: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """The points from which each index counts: the first capture and the counter reset."""
    days = [F.lit(first_day)]
    if first_day < RESET_DAY <= last_day:
        days.append(F.when(F.col("u") % 11 == 0, RESET_DAY))
    return (
        collections.withColumn(INDEX, F.explode(F.array(F.lit("k_lo"), F.lit("k_hi"))))
        .withColumn(DAY, F.explode(F.array_compact(F.array(*days))))
        .select("u", "e", "ft", INDEX, F.col(DAY).cast("int").alias(DAY), F.lit(0).alias(SECOND), F.lit(0).cast("long").alias("uses"))
    )


def _place(day: Column, second: Column) -> Column:
    """Order of captures; none of their seconds is beyond a day."""
    return day.cast("long") * SECONDS_PER_DAY + second


def _items(collections: DataFrame, uses: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """Starts and uses are ordered per index; each knows the place of the next one and emits itself for
    the captures up to there, with the count so far. Nothing is shuffled or sorted per capture."""
    u, h = F.col("u"), (F.col("u") % 3 + 1).cast("int")
    known = uses.where(F.col("u").isNotNull() & F.col("e").isNotNull())
    series = Window.partitionBy("u", "e", INDEX, "after_reset")
    in_order = series.orderBy("place")
    marks = (
        _starts(collections, first_day, last_day)
        .unionByName(known.withColumn("ft", F.lit(None).cast("long")))
        .withColumn("after_reset", (u % 11 == 0) & (F.col(DAY) >= RESET_DAY))
        .withColumn("place", _place(F.col(DAY), F.col(SECOND)))
    )
    day_after = F.when((u % 11 == 0) & ~F.col("after_reset"), F.least(F.lit(RESET_DAY), F.lit(last_day + 1)))
    end = _place(F.coalesce(day_after, F.lit(last_day + 1)), F.lit(0))
    counted = marks.select(
        "u", "e", INDEX, "after_reset", "place", DAY,
        F.max("ft").over(series).alias("ft"),
        F.coalesce(F.lead("place").over(in_order), end).alias("next_place"),
        F.sum("uses").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("UseCount"),
    )
    next_day = F.floor(F.col("next_place") / SECONDS_PER_DAY).cast("int")
    day, capture = F.col(DAY), _place(F.col(DAY), F.col(SECOND))
    counted = (
        counted.where("next_place > place")
        .withColumn(DAY, F.explode(F.sequence(day, F.least(next_day, F.lit(last_day)))))
        .withColumn("h", h)
        .withColumn(SECOND, F.explode(_seconds(F.col("h"), day)))
        .where((capture >= F.col("place")) & (capture < F.col("next_place")))
    )

    existed = (u % 2 == 0) | (event_epoch(DAY, SECOND) >= F.col("ft"))
    dropped = (u % 5 == 0) & (day >= DROP_DAY + u % 10)
    missing = (u % 7 == 0) & day.between(*GAP_DAYS)
    name = F.concat(
        F.when(u % 13 == 0, "audit_").otherwise(""),
        F.lit("c"), u.cast("string"), F.lit("_"), F.col("e"),
        F.when(u % 17 == 0, ".AnnotationSource.metas").otherwise(""),
    )
    since = (
        F.when(F.col("after_reset"), RESET_DAY * SECONDS_PER_DAY)
        .when(u % 2 == 0, (first_day - 1) * SECONDS_PER_DAY)
        .otherwise(F.col("ft"))
    )
    return (
        counted.filter(existed & ~dropped & ~missing)
        .withColumn(COLLECTION, name)
        .withColumn("Since", F.timestamp_seconds(since))
        .withColumn(HOST, F.format_string("mongo%02d", "h"))
        .select(*(F.col(f.name).cast(f.dataType) for f in OP_COUNT_ITEM.schema))
    )
