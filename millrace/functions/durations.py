"""Durations: day-time intervals in microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _of(n: Column, seconds: int) -> Column:
    exact = F.round(n.cast("decimal(38,12)") * seconds, 6).cast("decimal(18,6)")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), exact)


def days(n: Column) -> Column:
    return _of(n, 86400)


def hours(n: Column) -> Column:
    return _of(n, 3600)


def minutes(n: Column) -> Column:
    return _of(n, 60)


def seconds(n: Column) -> Column:
    return _of(n, 1)


def micros(d: Column) -> Column:
    """Whole microseconds of a duration."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.expr(EPOCH) + d)


def between(a: Column, b: Column) -> Column:
    """From `b` to `a`, both dates or datetimes."""
    return a.cast("timestamp_ntz") - b.cast("timestamp_ntz")


def total_seconds(d: Column) -> Column:
    return micros(d) / 1e6


def total_minutes(d: Column) -> Column:
    return micros(d) / 6e7


def total_hours(d: Column) -> Column:
    return micros(d) / 3.6e9


def total_days(d: Column) -> Column:
    return micros(d) / 8.64e10


def to_text(d: Column) -> Column:
    """`1d 02:03:04`, with microseconds where there are any."""
    m = micros(d)
    total = F.abs(m)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    whole = lambda size: F.floor(total / F.lit(size)).cast("bigint")
    clock = F.concat_ws(":", two(whole(3_600_000_000) % 24), two(whole(60_000_000) % 60), two(whole(1_000_000) % 60))
    part = F.regexp_replace(F.lpad((total % 1_000_000).cast("string"), 6, "0"), "0+$", "")
    clock = F.when(part == "", clock).otherwise(F.concat(clock, F.lit("."), part))
    n = whole(86_400_000_000)
    return F.when(m.isNotNull(), F.concat(F.when(m < 0, "-").otherwise(""), F.when(n > 0, F.concat(n.cast("string"), F.lit("d "))).otherwise(""), clock))
