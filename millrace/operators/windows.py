"""Window functions: built against partition, order and the table's row order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.functions.math import fdiv
from millrace.operators.aggregates import Agg, Scope, col


@dataclass(frozen=True)
class Frames:
    """Specifications over one partitioning: by row position, by peers, and over all rows of the partition."""

    rows: WindowSpec
    peers: WindowSpec
    whole: WindowSpec
    scope: Scope

    def last(self, n: int) -> WindowSpec:
        return self.rows.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class Win:
    build: Callable[[Frames], Column]

    def then(self, change: Callable[[Column], Column]) -> Win:
        return Win(lambda f: change(self.build(f)))


def _least(n: int) -> int:
    if not isinstance(n, int) or n < 1:
        raise ValueError("an offset or size is a whole number from 1 up")
    return n


def row_number() -> Win:
    return Win(lambda f: F.row_number().over(f.rows).cast("bigint"))


def rank() -> Win:
    return Win(lambda f: F.rank().over(f.peers).cast("bigint"))


def dense_rank() -> Win:
    return Win(lambda f: F.dense_rank().over(f.peers).cast("bigint"))


def percent_rank() -> Win:
    return Win(lambda f: F.percent_rank().over(f.peers))


def ntile(n: int) -> Win:
    return Win(lambda f: F.ntile(_least(n)).over(f.rows).cast("bigint"))


def lag(x, n: int = 1) -> Win:
    return Win(lambda f: F.lag(col(x), _least(n)).over(f.rows))


def lead(x, n: int = 1) -> Win:
    return Win(lambda f: F.lead(col(x), _least(n)).over(f.rows))


def diff(x, n: int = 1) -> Win:
    return Win(lambda f: col(x) - F.lag(col(x), _least(n)).over(f.rows))


def pct_change(x, n: int = 1) -> Win:
    def build(f: Frames) -> Column:
        before = F.lag(col(x), _least(n)).over(f.rows)
        return fdiv(col(x) - before, before)

    return Win(build)


def fill_forward(x) -> Win:
    return Win(lambda f: F.last(col(x), True).over(f.so_far))


def fill_backward(x) -> Win:
    return Win(lambda f: F.first(col(x), True).over(f.rows.rowsBetween(0, Window.unboundedFollowing)))


def cumsum(x) -> Win:
    return Win(lambda f: F.sum(col(x)).over(f.so_far))


def cum_count(x=None) -> Win:
    return Win(lambda f: F.count(F.lit(1) if x is None else col(x)).over(f.so_far))


def cum_min(x) -> Win:
    return Win(lambda f: F.min(col(x)).over(f.so_far))


def cum_max(x) -> Win:
    return Win(lambda f: F.max(col(x)).over(f.so_far))


def cum_mean(x) -> Win:
    return Win(lambda f: F.avg(col(x).cast("double")).over(f.so_far))


def moving_avg(x, n: int) -> Win:
    return Win(lambda f: F.avg(col(x).cast("double")).over(f.last(_least(n))))


def moving_sum(x, n: int) -> Win:
    return Win(lambda f: F.sum(col(x)).over(f.last(_least(n))))


def moving_min(x, n: int) -> Win:
    return Win(lambda f: F.min(col(x)).over(f.last(_least(n))))


def moving_max(x, n: int) -> Win:
    return Win(lambda f: F.max(col(x)).over(f.last(_least(n))))


def first_row(x) -> Win:
    """The value in the partition's first row."""
    return Win(lambda f: F.first(col(x)).over(f.rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def last_row(x) -> Win:
    return Win(lambda f: F.last(col(x)).over(f.rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def distinct_in(x) -> Win:
    """count_distinct over the partition."""
    return Win(lambda f: F.size(F.collect_set(col(x)).over(f.whole)).cast("bigint"))


def over(agg: Agg) -> Win:
    """Any aggregate of one column over the whole partition."""
    if agg.columns > 1:
        raise ValueError("an aggregate of two columns cannot be used in a window")
    if agg.ordered:
        raise ValueError("use first_row and last_row in a window")
    return Win(lambda f: agg.build(f.scope).over(f.whole))
