"""Dates and datetimes (without zone)."""

from __future__ import annotations

import datetime as dt
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.durations import EPOCH, micros

#: strftime codes and the Java letters for them; a fixed table of formats.
CODES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%e": "d", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%f": "SSSSSS", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss",
}
LENIENT = {"%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%e": "d"}


def java_format(pattern: str, lenient: bool = False) -> str:
    """The strftime pattern as Java reads it; codes of zones are refused."""
    out, literal = [], ""

    def flush() -> str:
        return "'" + literal.replace("'", "''") + "'" if any(c.isalpha() or c in "'%" for c in literal) else literal

    for piece in re.findall(r"%.|[^%]|%$", pattern, re.S):
        if piece in CODES:
            out += [flush(), LENIENT.get(piece, CODES[piece]) if lenient else CODES[piece]]
            literal = ""
        elif piece == "%%" or len(piece) == 1:
            literal += piece[0]
        else:
            raise ValueError(f"{piece} cannot be used in a date pattern")
    return "".join([*out, flush()])


_clock: list[dt.datetime] = []


def clock() -> dt.datetime:
    """The time of the run's first reading, so that a run has one; MILLRACE_NOW (ISO) sets it."""
    if not _clock:
        given = os.environ.get("MILLRACE_NOW")
        _clock.append(dt.datetime.fromisoformat(given) if given else dt.datetime.now(dt.UTC).replace(tzinfo=None))
    return _clock[0]


def now() -> Column:
    return F.lit(clock().isoformat(sep=" ")).cast("timestamp_ntz")


def today() -> Column:
    return F.lit(clock().date().isoformat()).cast("date")


def _part(of):
    return lambda d: of(d).cast("bigint")


year, month, day, quarter = _part(F.year), _part(F.month), _part(F.dayofmonth), _part(F.quarter)
week, day_of_year = _part(F.weekofyear), _part(F.dayofyear)


def hour(d: Column) -> Column:
    return F.hour(d.cast("timestamp_ntz")).cast("bigint")


def minute(d: Column) -> Column:
    return F.minute(d.cast("timestamp_ntz")).cast("bigint")


def second(d: Column) -> Column:
    return F.second(d.cast("timestamp_ntz")).cast("bigint")


def weekday(d: Column) -> Column:
    """1 is Monday, 7 Sunday."""
    return (F.weekday(d) + 1).cast("bigint")


def month_name(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def day_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def start_of_week(d: Column) -> Column:
    return F.trunc(d, "week")


def start_of_month(d: Column) -> Column:
    return F.trunc(d, "month")


def start_of_quarter(d: Column) -> Column:
    return F.trunc(d, "quarter")


def start_of_year(d: Column) -> Column:
    return F.trunc(d, "year")


def end_of_month(d: Column) -> Column:
    return F.last_day(d)


def _n(n) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def add_days(d: Column, n, datetime: bool = False) -> Column:
    return F.timestamp_add("DAY", _n(n), d) if datetime else F.date_add(d, _n(n).cast("int"))


def add_months(d: Column, n, datetime: bool = False) -> Column:
    """Stops at the end of a shorter month."""
    return F.timestamp_add("MONTH", _n(n), d) if datetime else F.add_months(d, _n(n).cast("int"))


def add_years(d: Column, n, datetime: bool = False) -> Column:
    return add_months(d, _n(n) * 12, datetime)


def days_between(a: Column, b: Column) -> Column:
    """Whole periods of 24 hours from a to b, toward zero."""
    return F.timestamp_diff("DAY", a.cast("timestamp_ntz"), b.cast("timestamp_ntz"))


def months_between(a: Column, b: Column) -> Column:
    """Whole months from a to b; a month is complete on the same day, or on the last of a shorter month."""
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    count = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)

    def clock(t: Column) -> Column:
        return F.timestamp_diff("MICROSECOND", F.date_trunc("day", t).cast("timestamp_ntz"), t)

    def reaches(early: Column, late: Column) -> Column:
        goal = F.least(F.dayofmonth(early), F.dayofmonth(F.last_day(late)))
        return (F.dayofmonth(late) > goal) | ((F.dayofmonth(late) == goal) & (clock(late) >= clock(early)))

    forward = count - F.when(reaches(a, b), 0).otherwise(1)
    backward = count + F.when(reaches(b, a), 0).otherwise(1)
    return F.when(b >= a, forward).otherwise(backward).cast("bigint")


def years_between(a: Column, b: Column) -> Column:
    return F.call_function("div", months_between(a, b), F.lit(12))


def make_date(y: Column, m: Column, d: Column) -> Column:
    return F.make_date(y.cast("int"), m.cast("int"), d.cast("int"))


def make_datetime(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return F.make_timestamp_ntz(*(x.cast("int") for x in (y, m, d, h, mi)), s)


def format_date(d: Column, pattern: str, era: str | None = None) -> Column:
    """strftime; the era "buddhist" counts years from 543 years before."""
    if era is None:
        return F.date_format(d, java_format(pattern))
    if era != "buddhist":
        raise ValueError(f"no era is called {era}")
    pieces = pattern.replace("%F", "%Y-%m-%d").split("%Y")
    out: list[Column] = []
    for i, piece in enumerate(pieces):
        if i:
            out.append((F.year(d) + 543).cast("string"))
        for k, rest in enumerate(piece.split("%y")):
            if k:
                out.append(F.lpad(((F.year(d) + 543) % 100).cast("string"), 2, "0"))
            if rest:
                out.append(F.date_format(d, java_format(rest)))
    return F.concat(*out)


def parse_date(s: Column, pattern: str) -> Column:
    """Fails if the text does not fit; leading zeros may be left out."""
    return F.to_date(s, java_format(pattern, lenient=True))


def parse_datetime(s: Column, pattern: str) -> Column:
    return F.to_timestamp_ntz(s, F.lit(java_format(pattern, lenient=True)))


def try_parse_date(s: Column, pattern: str) -> Column:
    return F.try_to_timestamp(s, F.lit(java_format(pattern, lenient=True))).cast("date")


def try_parse_datetime(s: Column, pattern: str) -> Column:
    return F.try_to_timestamp(s, F.lit(java_format(pattern, lenient=True))).cast("timestamp_ntz")


def _since_epoch(d: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), d.cast("timestamp_ntz"))


def time_bucket(d: Column, size: Column) -> Column:
    """Start of the bucket of `size` (a duration) since the epoch."""
    m = _since_epoch(d)
    return F.timestamp_add("MICROSECOND", m - F.pmod(m, micros(size)), F.expr(EPOCH))


def to_unix(d: Column) -> Column:
    m = _since_epoch(d)
    return F.call_function("div", m - F.pmod(m, F.lit(1_000_000).cast("bigint")), F.lit(1_000_000))


def from_unix(n: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.round(n.cast("decimal(38,9)") * 1_000_000).cast("bigint"), F.expr(EPOCH))


def fiscal_year(d: Column, first_month: int) -> Column:
    """The year that the fiscal year ends in."""
    if not 1 <= first_month <= 12:
        raise ValueError("a month is a number from 1 to 12")
    later = F.when(F.month(d) >= first_month, 1).otherwise(0) if first_month > 1 else F.lit(0)
    return (F.year(d) + later).cast("bigint")


def buddhist_year(d: Column) -> Column:
    return (F.year(d) + 543).cast("bigint")
