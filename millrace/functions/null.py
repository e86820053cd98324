"""Choosing between values and handling missing ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_null(x: Column) -> Column:
    """Whether the value is missing; never null itself."""
    return x.isNull()


def _all_known(values: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a & b, (v.isNotNull() for v in values))


def greatest(*values: Column) -> Column:
    """The largest, null if any is null; NaN is above all numbers."""
    return F.when(_all_known(values), F.greatest(*values))


def least(*values: Column) -> Column:
    """The smallest, null if any is null."""
    return F.when(_all_known(values), F.least(*values))


def null_if(x: Column, value) -> Column:
    """Null where `x` equals `value`."""
    return F.nullif(x, value if isinstance(value, Column) else F.lit(value))


def if_null(a: Column, b) -> Column:
    """`a`, or `b` where it is missing."""
    return F.coalesce(a, b if isinstance(b, Column) else F.lit(b))


def if_else(condition: Column, yes, no) -> Column:
    """`yes` where the condition is true, else (also for null) `no`; each is only computed on its rows."""
    return F.when(condition, yes).otherwise(no)


def match(x: Column, cases: dict, otherwise=None) -> Column:
    """The value of the first case that equals `x`; the case None is for null."""
    out = None
    for key, value in cases.items():
        test = x.isNull() if key is None else x == F.lit(key)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def is_in(x: Column, values: list) -> Column:
    """Whether `x` is one of the values: null for null, and for no match where a value is null."""
    return x.isin(*values) if values else F.when(x.isNotNull(), F.lit(False))


def between(x: Column, low, high) -> Column:
    return x.between(low, high)


def clamp(x: Column, low, high) -> Column:
    """`x` held within the bounds; null if any is null."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return least(greatest(x, low), high)
