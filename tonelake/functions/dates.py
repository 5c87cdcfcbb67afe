"""Time buckets in the caller's zone, calendars and day ranges.

Ranges are whole UTC days, both ends included; buckets are local wall-clock starts as text.  A bucket that local time
moves out of the calendar's days is left out.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label formats by interval.
LABELS = {"hour": "yyyy-MM-dd'T'HH:00:00", "day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM-01"}


def in_days(c: Column, first: date, last: date) -> Column:
    """Half-open: from the first day's start to before the day after the last; reaches the scan as two comparisons."""
    return (c >= F.lit(str(first)).cast("timestamp")) & (c < F.lit(str(last + timedelta(days=1))).cast("timestamp"))


def local(c: Column, tz: str) -> Column:
    return c if tz == "UTC" else F.from_utc_timestamp(c, tz)


def week_start(d: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def bucket(c: Column, interval: str, tz: str = "UTC") -> Column:
    at = local(c, tz)
    return F.date_format(week_start(F.to_date(at)) if interval == "week" else at, LABELS[interval])


def sunday_zero(c: Column) -> Column:
    return F.dayofweek(c) - 1


def monday_zero(c: Column) -> Column:
    return F.weekday(c)


def series(spark: SparkSession, start: str, stop: str, step: str, name: str = "t") -> DataFrame:
    """Timestamps from start to stop, both included, one every step such as '1 hour'."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(timestamp'{start}', timestamp'{stop}', interval {step})")).alias(name))


def calendar(spark: SparkSession, first: date, last: date, interval: str) -> DataFrame:
    """The dense bucket labels `t` of a range; as many rows as buckets, made on the executors."""
    begin = first - timedelta(days=(first.weekday() + 1) % 7) if interval == "week" else first.replace(day=1) if interval == "month" else first
    end = f"{last} 23:00:00" if interval == "hour" else f"{last} 00:00:00"
    step = {"hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month"}[interval]
    return series(spark, f"{begin} 00:00:00", end, step).select(F.date_format("t", LABELS[interval]).alias("t"))
