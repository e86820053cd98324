"""Aggregates: built against a table, so that they can use its row order and which columns may be missing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.math import fdiv


@dataclass(frozen=True)
class Scope:
    """What an aggregate sees: the row order as one orderable column, and the columns that are never null."""

    order: Column | None = None
    known: frozenset[str] = frozenset()
    types: dict[str, str] = field(default_factory=dict)
    #: Only rows where this holds count, as in a pivot.
    condition: Column | None = None

    def of(self, x) -> Column:
        """The column `x` on the rows that count, null on others."""
        return col(x) if self.condition is None else F.when(self.condition, col(x))


@dataclass(frozen=True)
class Agg:
    """An aggregate; `then` computes on its result. `columns` is the number of columns it takes."""

    build: Callable[[Scope], Column]
    columns: int = 1
    ordered: bool = False
    pivots: bool = True
    counts: bool = False

    def then(self, change: Callable[[Column], Column]) -> Agg:
        return Agg(lambda s: change(self.build(s)), self.columns, self.ordered, self.pivots)

    def with_(self, other: Agg, change: Callable[[Column, Column], Column]) -> Agg:
        return Agg(lambda s: change(self.build(s), other.build(s)), max(self.columns, other.columns), self.ordered or other.ordered, self.pivots and other.pivots)


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _plain(of: Callable[[Column], Column]):
    def make(x) -> Agg:
        return Agg(lambda s: of(s.of(x)))

    return make


def count(x=None) -> Agg:
    """Rows, or values that are there."""
    return Agg(lambda s: F.count(s.of(F.lit(1) if x is None else x)), counts=True)


def count_distinct(x) -> Agg:
    return Agg(lambda s: F.count_distinct(s.of(x)), counts=True)


def sum_(x) -> Agg:
    """Of ints through 38 digits, so that only the final value can overflow; 0 over no rows where `x` is never null."""

    def build(s: Scope) -> Column:
        kind = s.types.get(x, "") if isinstance(x, str) else ""
        if kind in ("bigint", "int", "smallint", "tinyint"):
            total = F.sum(s.of(x).cast("decimal(38,0)")).cast("bigint")
        elif kind.startswith("decimal"):
            total = F.sum(s.of(x)).cast("decimal(38,6)")
        else:
            total = F.sum(s.of(x))
        return F.coalesce(total, F.lit(0)) if isinstance(x, str) and x in s.known else total

    return Agg(build)


mean = _plain(lambda x: F.avg(x.cast("double")))
median = _plain(lambda x: F.median(x))
stddev, variance = _plain(F.stddev_samp), _plain(F.var_samp)
stddev_pop, variance_pop = _plain(F.stddev_pop), _plain(F.var_pop)
product = _plain(lambda x: F.product(x.cast("double")))
min_, max_ = _plain(F.min), _plain(F.max)
any_, all_ = _plain(F.bool_or), _plain(F.bool_and)


def quantile(x, share: float) -> Agg:
    """By linear interpolation between the two nearest values."""
    if not 0 <= share <= 1:
        raise ValueError("a share is a number from 0 to 1")
    return Agg(lambda s: F.percentile(s.of(x).cast("double"), F.lit(float(share))))


def count_if(condition) -> Agg:
    return Agg(lambda s: F.count_if(s.of(condition)), counts=True)


def count_null(x) -> Agg:
    return Agg(lambda s: F.count_if(s.of(col(x).isNull())), counts=True)


def first(x) -> Agg:
    """Of the first row, null or not."""
    return Agg(lambda s: F.min_by(F.struct(s.of(x).alias("v")), s.order)["v"], ordered=True, pivots=False)


def last(x) -> Agg:
    return Agg(lambda s: F.max_by(F.struct(s.of(x).alias("v")), s.order)["v"], ordered=True, pivots=False)


def string_agg(x, separator: str = ",") -> Agg:
    """The strings that are there, in row order; null if there is none."""

    def build(s: Scope) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(s.of(x).isNotNull(), F.struct(s.order.alias("o"), s.of(x).alias("v")))))
        return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: p["v"]), separator))

    return Agg(build, ordered=True)


def arg_max(x, by) -> Agg:
    """`x` of the first of the rows with the largest `by`."""

    def build(s: Scope) -> Column:
        key = F.when(s.of(by).isNotNull(), F.struct(s.of(by).alias("b"), reversed_order(s.order)))
        return F.max_by(F.struct(s.of(x).alias("v")), key)["v"]

    return Agg(build, 2, ordered=True)


def arg_min(x, by) -> Agg:
    def build(s: Scope) -> Column:
        key = F.when(s.of(by).isNotNull(), F.struct(s.of(by).alias("b"), s.order.alias("o")))
        return F.min_by(F.struct(s.of(x).alias("v")), key)["v"]

    return Agg(build, 2, ordered=True)


def reversed_order(order: Column) -> Column:
    """A long order, negated: the first of equals is then the largest."""
    return (-order).alias("o")


def weighted_mean(x, weight) -> Agg:
    def build(s: Scope) -> Column:
        x_, w = s.of(x).cast("double"), s.of(weight).cast("double")
        return fdiv(F.sum(x_ * w), F.sum(F.when(x_.isNotNull(), w)))

    return Agg(build, 2)


def corr(y, x) -> Agg:
    """Pearson's correlation, null where a side does not vary."""
    def build(s: Scope) -> Column:
        a, b = s.of(y).cast("double"), s.of(x).cast("double")
        return F.regr_sxy(a, b) / F.nullif(F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b)), F.lit(0.0))

    return Agg(build, 2)


def cov(y, x) -> Agg:
    return Agg(lambda s: F.covar_samp(s.of(y).cast("double"), s.of(x).cast("double")), 2)


def slope(y, x) -> Agg:
    return Agg(lambda s: F.regr_slope(s.of(y).cast("double"), s.of(x).cast("double")), 2)


def intercept(y, x) -> Agg:
    return Agg(lambda s: F.regr_intercept(s.of(y).cast("double"), s.of(x).cast("double")), 2)
