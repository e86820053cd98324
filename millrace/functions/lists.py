"""Lists and maps: as array and map columns. Program values are plain Python lists and dicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(xs: Column) -> Column:
    return F.size(xs).cast("bigint")


def range_(start: Column, stop: Column) -> Column:
    """Whole numbers from start up to, but without, stop."""
    return F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))


def map_(xs: Column, f: Callable) -> Column:
    return F.transform(xs, f)


def filter_(xs: Column, f: Callable) -> Column:
    return F.filter(xs, f)


def fold(xs: Column, start: Column, f: Callable) -> Column:
    return F.aggregate(xs, start, f)


def any_(xs: Column, f: Callable) -> Column:
    return F.exists(xs, f)


def all_(xs: Column, f: Callable) -> Column:
    return F.forall(xs, f)


def find(xs: Column, f: Callable) -> Column:
    return F.get(F.filter(xs, f), F.lit(0))


def count(xs: Column, f: Callable) -> Column:
    return F.size(F.filter(xs, f)).cast("bigint")


def sort(xs: Column, down: bool = False) -> Column:
    """Nulls last, whatever the direction."""
    return F.sort_array(xs, False) if down else F.array_sort(xs)


def sort_by(xs: Column, key: Callable) -> Column:
    pairs = F.array_sort(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    return F.transform(pairs, lambda p: p["x"])


def total(xs: Column) -> Column:
    return F.aggregate(F.filter(xs, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    known = F.filter(xs, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, total(xs) / F.size(known))


min_, max_ = F.array_min, F.array_max


def contains(xs: Column, x) -> Column:
    return F.array_contains(xs, x)


def index_of(xs: Column, x) -> Column:
    """From 0; null if it is not there."""
    return F.nullif(F.array_position(xs, x), F.lit(0).cast("bigint")) - 1


def join(xs: Column, separator: str) -> Column:
    return F.array_join(xs, separator)


reverse, distinct, flatten = F.reverse, F.array_distinct, F.flatten


def take(xs: Column, n: int) -> Column:
    return F.slice(xs, F.lit(1), F.lit(n))


def skip(xs: Column, n: int) -> Column:
    return F.slice(xs, F.lit(n + 1), F.greatest(F.size(xs) - n, F.lit(0)))


def slice_(xs: Column, start: int, stop: int) -> Column:
    return F.slice(xs, F.lit(start + 1), F.lit(max(stop - start, 0)))


def first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def concat(xs: Column, ys: Column) -> Column:
    return F.concat(xs, ys)


keys, values, entries = F.map_keys, F.map_values, F.map_entries


def has_key(m: Column, key) -> Column:
    return F.map_contains_key(m, key)


def put(m: Column, key, value: Column) -> Column:
    return merge(m, F.create_map(F.lit(key), value))


def remove(m: Column, key) -> Column:
    return F.map_filter(m, lambda k, _: k != F.lit(key))


def merge(a: Column, b: Column) -> Column:
    """Both; where a key is in both, the value of b."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def with_field(record: Column, name: str, value: Column) -> Column:
    """The record with a field added or replaced."""
    return record.withField(name, value)
