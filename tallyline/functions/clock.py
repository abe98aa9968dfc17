"""Instants kept as a pair of integers (days since the epoch, seconds of the day)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def event_epoch(days: Column | str, seconds: Column | str) -> Column:
    """Epoch seconds as BIGINT; 32-bit arithmetic would overflow in January 2038."""
    return _col(days).cast("bigint") * F.lit(SECONDS_PER_DAY) + _col(seconds).cast("bigint")


def event_text(days: Column | str, seconds: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session time zone is."""
    zero = F.lit(0)
    elapsed = F.make_dt_interval(_col(days), zero, zero, _col(seconds))
    return (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + elapsed).cast("string")


def elapsed(
    from_day: Column, from_second: Column, to_day: Column, to_second: Column
) -> tuple[Column, Column]:
    """Whole days and left-over seconds between two instants, borrowing a day if needed."""
    seconds = to_second - from_second
    days = to_day - from_day
    borrow = seconds < 0
    return (
        F.when(borrow, days - 1).otherwise(days).cast("int"),
        F.when(borrow, seconds + SECONDS_PER_DAY).otherwise(seconds).cast("int"),
    )


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
