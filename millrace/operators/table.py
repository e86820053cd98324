"""Tables: lazy DataFrames with the verbs, checks and row order of a pipeline language.

A table knows its row order only if it needs to: the first verb that depends on order adds a hidden ordinal, and
verbs carry it along. Pipelines that never ask for order never pay for it. Mistakes in a plan (unknown or
repeated columns, bad counts, clashing names) are errors when the plan is built, before any row is read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import hashing, text
from millrace.operators.aggregates import Agg, Scope
from millrace.operators.windows import Frames, Win
from millrace.session import written

ORD = "__ord"


class PlanError(ValueError):
    """A mistake in a plan."""


def desc(x) -> tuple:
    return (x, True)


def asc(x) -> tuple:
    return (x, False)


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _flag(key, nulls: str) -> str:
    """The letter of a sort key's direction: a, d (nulls last), f, e (nulls first)."""
    down = isinstance(key, tuple) and key[1]
    return ("e" if down else "f") if nulls == "first" else ("d" if down else "a")


def _direction(name: str, back: bool = False) -> Column:
    """The order that a hidden column's letter names, or its reverse."""
    letter = name[len(ORD)]
    if back:
        letter = {"a": "e", "d": "f", "f": "d", "e": "a"}[letter]
    c = F.col(name)
    return {"a": c.asc_nulls_last, "d": c.desc_nulls_last, "f": c.asc_nulls_first, "e": c.desc_nulls_first}[letter]()


def _ordered(key, nulls: str) -> Column:
    c = _column(key[0] if isinstance(key, tuple) else key)
    return {"a": c.asc_nulls_last, "d": c.desc_nulls_last, "f": c.asc_nulls_first, "e": c.desc_nulls_first}[_flag(key, nulls)]()


class Table:
    """`df` holds the columns and, if `ord` is not empty, hidden columns that the rows are in order of."""

    def __init__(self, df: DataFrame, ord: tuple[str, ...] = (), known: frozenset[str] = frozenset()):  # noqa: A002
        self.df, self.ord, self.known = df, ord, known

    # -- what it is

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    @property
    def types(self) -> dict[str, str]:
        return {n: t for n, t in self.df.dtypes if not n.startswith("__")}

    @staticmethod
    def from_rows(spark: SparkSession, rows: list[dict], schema: str | None = None) -> Table:
        """Rows in order; the schema is read from them if it is not given."""
        if not rows and schema is None:
            raise PlanError("no rows to read column types from")
        frame = spark.createDataFrame([tuple(r.values()) for r in rows], schema or list(rows[0]))
        if not frame.columns:
            raise PlanError("a table needs a column")
        full = f"{schema}, {ORD}a0 bigint" if schema else [*rows[0], f"{ORD}a0"]
        return Table(spark.createDataFrame([(*r.values(), i) for i, r in enumerate(rows)], full), (f"{ORD}a0",))

    def declare(self, *columns: str) -> Table:
        """Says that these columns are never null; a null in them is an error when it is read."""
        self._known(*columns)
        df = self.df
        for c in columns:
            kind = dict(df.dtypes)[c]
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"missing value in {c}, which is declared never to be")).cast(kind)))
        return Table(df, self.ord, self.known | set(columns))

    def _known(self, *names: str) -> None:
        for n in names:
            if n not in self.columns:
                raise PlanError(f"there is no column {n}; there are: {', '.join(self.columns)}")

    def _next(self, df: DataFrame, ord: tuple[str, ...] | None = None, known=None) -> Table:  # noqa: A002
        keep = self.known if known is None else frozenset(known)
        return Table(df, self.ord if ord is None else ord, keep & set(df.columns))

    def numbered(self) -> Table:
        """With a row order: that of the files and their rows, if none is known yet."""
        if self.ord:
            return self
        return Table(self.df.withColumn(f"{ORD}a0", F.monotonically_increasing_id()), (f"{ORD}a0",), self.known)

    def _order(self, back: bool = False) -> list[Column]:
        return [_direction(c, back) for c in self.ord]

    def single_order(self) -> Table:
        """With the order in one bigint column: the row number where it was in several.

        Rows are ranged by their order; a range's rows are numbered from the counts of those before it, so no
        task gets all rows. The ranges are written once: their borders are found from samples, and would differ
        between the jobs that count and number the rows.
        """
        t = self.numbered()
        if len(t.ord) == 1 and t.ord[0][len(ORD)] == "a" and dict(t.df.dtypes)[t.ord[0]] == "bigint":
            return t
        parts = int(t.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = written(t.df.repartitionByRange(parts, *t._order()).withColumn("__part", F.spark_partition_id()), "ranges")
        counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
        before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
        n = F.row_number().over(Window.partitionBy("__part").orderBy(*t._order())) - 1
        df = ranged.join(before, "__part").withColumn("__row", (n + F.col("__before")).cast("bigint"))
        df = df.drop(*t.ord, "__part", "__before").withColumnRenamed("__row", f"{ORD}a0")
        return Table(df, (f"{ORD}a0",), t.known)

    def ordered(self) -> DataFrame:
        """The visible columns, in row order if there is one."""
        df = self.df.orderBy(*self._order()) if self.ord else self.df
        return df.select(*self.columns)

    def plain(self) -> DataFrame:
        """The visible columns, in no order."""
        return self.df.select(*self.columns)

    # -- rows and columns

    def where(self, condition: Column) -> Table:
        """Rows where the condition is true; null drops a row."""
        kind = self.df.select(condition.alias("c")).dtypes[0][1]
        if kind != "boolean":
            raise PlanError(f"a condition is a bool, not {kind}")
        return self._next(self.df.filter(condition))

    def select(self, *names: str, **exprs) -> Table:
        wanted = [*names, *exprs]
        if not wanted:
            raise PlanError("select needs a column")
        if len(set(wanted)) < len(wanted):
            raise PlanError("a column is selected twice")
        self._known(*names)
        df = self.df.select(*names, *(_column(e).alias(n) for n, e in exprs.items()), *self.ord)
        return self._next(df, known=self.known & set(names))

    def drop(self, *names: str) -> Table:
        self._known(*names)
        if set(names) == set(self.columns):
            raise PlanError("not every column can be dropped")
        return self._next(self.df.drop(*names))

    def rename(self, **names: str) -> Table:
        """new = old; places are kept."""
        self._known(*names.values())
        after = [next((n for n, o in names.items() if o == c), c) for c in self.columns]
        if len(set(after)) < len(after):
            raise PlanError("two columns would have one name")
        old = {o: n for n, o in names.items()}
        return self._next(self.df.withColumnsRenamed(old), known={old.get(c, c) for c in self.known})

    def derive(self, **exprs) -> Table:
        """Adds or replaces columns in turn: later ones see earlier ones."""
        if not exprs:
            raise PlanError("derive needs a column")
        df = self.df
        for n, e in exprs.items():
            df = df.withColumn(n, _column(e) if isinstance(e, (str, Column)) else F.lit(e))
        return self._next(df, known=self.known - set(exprs))

    def sort(self, *keys, nulls: str = "last") -> Table:
        """Stable; nulls last, whatever the direction, unless nulls="first". The rows move when they are taken or written:
        the keys become the row order."""
        if not keys:
            raise PlanError("sort needs a key")
        if nulls not in ("first", "last"):
            raise PlanError("nulls is first or last")
        t = self.numbered()
        flags = [_flag(k, nulls) for k in keys]
        hidden = {f"{ORD}{f}s{i}": _column(k[0] if isinstance(k, tuple) else k) for i, (f, k) in enumerate(zip(flags, keys, strict=True))}
        n = len(keys)
        old = {c: f"{ORD}{c[len(ORD)]}s{n + i}" for i, c in enumerate(t.ord)}
        df = t.df.select(*t.columns, *(e.alias(name) for name, e in hidden.items()), *(F.col(c).alias(name) for c, name in old.items()))
        return Table(df, (*hidden, *old.values()), t.known)

    def take(self, n: int) -> Table:
        if n < 0:
            raise PlanError("a number of rows is not negative")
        t = self.numbered()
        return t._next(t.df.orderBy(*t._order()).limit(n))

    def skip(self, n: int) -> Table:
        """All rows but the first n. `take` right after it is one top-n; else rows are numbered by ranges."""
        if n < 0:
            raise PlanError("a number of rows is not negative")
        return _Skipped(self, n)

    def tail(self, n: int) -> Table:
        """The last n rows, in their order."""
        t = self.numbered()
        if n < 0:
            raise PlanError("a number of rows is not negative")
        return t._next(t.df.orderBy(*t._order(back=True)).limit(n))

    def row_numbers(self, name: str) -> Table:
        """With a row number from 0 in the column `name`."""
        # A fresh ordinal has gaps between partitions; numbering by two columns closes them.
        t = self.numbered()
        both = Table(t.df.withColumn(f"{ORD}az", F.lit(0)), (*t.ord, f"{ORD}az"), t.known).single_order()
        return both._next(both.df.withColumn(name, F.col(both.ord[0])))

    def sample(self, n: int | None = None, fraction: float | None = None, seed: int = 0, key: str | None = None) -> Table:
        """Rows picked by a hash of the row number, or of the column `key`: the same ones every time."""
        if (n is None) == (fraction is None):
            raise PlanError("sample takes a number of rows or a fraction")
        if fraction is not None and not 0 <= fraction <= 1:
            raise PlanError("a fraction is from 0 to 1")
        t = self if key else self.row_numbers("__row")
        name = key or "__row"
        hashed = t.df.withColumn("__h", hashing.stable_hash(F.col(name), dict(t.df.dtypes)[name], seed))
        if fraction is not None:
            return t._next(hashed.filter(F.col("__h") / float(1 << 63) < fraction).drop("__h", "__row"))
        return t._next(hashed.orderBy("__h", name).limit(n).drop("__h", "__row"))

    def drop_nulls(self, *names: str) -> Table:
        self._known(*names)
        some = names or tuple(self.columns)
        return self._next(self.df.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in some))), known=self.known | set(some))

    def fill_nulls(self, **values) -> Table:
        self._known(*values)
        kinds = self.types
        df = self.df.withColumns({c: F.coalesce(F.col(c), _column(v).cast(kinds[c]) if isinstance(v, Column) else F.lit(v).cast(kinds[c])) for c, v in values.items()})
        return self._next(df, known=self.known | set(values))

    def distinct(self, *names: str) -> Table:
        """Rows that differ (in the named columns, which alone remain), where they first appear."""
        self._known(*names)
        some = names or tuple(self.columns)
        if not self.ord:
            return self._next(self.df.select(*some).distinct())
        t = self.single_order()
        return t._next(t.df.groupBy(*some).agg(F.min(t.ord[0]).alias(f"{ORD}a0")), (f"{ORD}a0",))

    # -- sets

    def _same(self, other: Table) -> Table:
        if sorted(self.columns) != sorted(other.columns):
            raise PlanError("the tables have different columns")
        if any(other.types[c] != k for c, k in self.types.items()):
            raise PlanError("the tables' columns have different types")
        return other

    def union(self, *others: Table) -> Table:
        """All rows of all tables, by column name, in their order."""
        tables = [self, *map(self._same, others)]
        if not any(t.ord for t in tables):
            return self._next(reduce(lambda a, b: a.unionByName(b), (t.plain().select(*self.columns) for t in tables)), ())
        parts = [t.single_order() for t in tables]
        frames = [t.df.select(*self.columns, F.lit(i).cast("bigint").alias(f"{ORD}a0"), F.col(t.ord[0]).alias(f"{ORD}a1")) for i, t in enumerate(parts)]
        return self._next(reduce(lambda a, b: a.unionByName(b), frames), (f"{ORD}a0", f"{ORD}a1"))

    def _set(self, other: Table, how: str) -> Table:
        self._same(other)
        mine = self.distinct()
        theirs = other.plain().select(*self.columns).distinct().select(*(F.col(c).alias(f"__r_{c}") for c in self.columns))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in self.columns))
        return mine._next(mine.df.join(theirs, same, how))

    def intersect(self, other: Table) -> Table:
        """Distinct rows that are in both; null equals null."""
        return self._set(other, "left_semi")

    def except_(self, other: Table) -> Table:
        return self._set(other, "left_anti")

    # -- joins

    def join(self, other: Table, on: str | list[str] | None = None, left_on=None, right_on=None, how: str = "inner") -> Table:
        """Equi-joins; null keys never meet. With `on`, one key column; full and right joins take it from either side."""
        if how not in ("inner", "left", "right", "full", "semi", "anti", "cross"):
            raise PlanError(f"there is no {how} join")
        aslist = lambda x: [x] if isinstance(x, str) else list(x or [])
        left, right = (aslist(on), aslist(on)) if on else (aslist(left_on), aslist(right_on))
        if (how == "cross") == bool(left or right):
            raise PlanError("a cross join takes no keys; all others do")
        if len(left) != len(right):
            raise PlanError("the sides have different numbers of keys")
        self._known(*left)
        other._known(*right)
        for a, b in zip(left, right, strict=True):
            if self.types[a] != other.types[b]:
                raise PlanError(f"the keys {a} and {b} have different types")
        shared = set(left) if on else set()
        if how not in ("semi", "anti") and (clash := (set(self.columns) & set(other.columns)) - shared):
            raise PlanError(f"both tables have a column {', '.join(sorted(clash))}")
        l_ord = [f"{ORD}{c[len(ORD)]}l{i}" for i, c in enumerate(self.ord)]
        r_ord = [f"{ORD}{c[len(ORD)]}r{i}" for i, c in enumerate(other.ord)]
        lf = self.df.withColumnsRenamed(dict(zip(self.ord, l_ord, strict=True)))
        rf = other.df.withColumnsRenamed(dict(zip(other.ord, r_ord, strict=True)) | {c: f"__r_{c}" for c in right})
        meet = reduce(lambda a, b: a & b, (F.col(a) == F.col(f"__r_{b}") for a, b in zip(left, right, strict=True))) if left else None
        if how in ("semi", "anti"):
            return self._next(lf.join(rf, meet, f"left_{how}"), tuple(l_ord))
        joined = lf.crossJoin(rf) if how == "cross" else lf.join(rf, meet, how)
        keys = {c: F.coalesce(F.col(c), F.col(f"__r_{c}")) if how in ("right", "full") else F.col(c) for c in left} if on else {}
        columns = [keys.get(c, F.col(c)).alias(c) for c in self.columns]
        columns += [F.col(f"__r_{c}" if c in right else c).alias(c) for c in other.columns if c not in shared]
        order = (*r_ord, *l_ord) if how == "right" else (*l_ord, *r_ord)
        if not (self.ord and other.ord):
            order = tuple(l_ord) if self.ord and how != "right" else tuple(r_ord) if other.ord and how == "right" else ()
        known = (self.known if how in ("inner", "left", "cross") else frozenset()) | (other.known if how in ("inner", "cross", "right") else frozenset())
        return Table(joined.select(*columns, *order), order, frozenset(known & {*self.columns, *other.columns}))

    # -- groups

    def group(self, *names: str, **exprs) -> Grouped:
        keys = [*names, *exprs]
        if not keys:
            raise PlanError("group needs a column")
        if len(set(keys)) < len(keys):
            raise PlanError("a column is grouped by twice")
        self._known(*names)
        return Grouped(self.derive(**exprs) if exprs else self, keys)

    def agg(self, **aggs: Agg) -> Table:
        """Over all rows: exactly one row."""
        return Grouped(self, []).agg(**aggs)

    def count_by(self, *names: str) -> Table:
        """Rows of each value, the most frequent first, equal ones by first appearance."""
        if "count" in names:
            raise PlanError("a column called count is in the way")
        t = self.single_order()
        t._known(*names)
        df = t.df.groupBy(*names).agg(F.count(F.lit(1)).alias("count"), F.min(t.ord[0]).alias(f"{ORD}a1"))
        df = df.withColumn(f"{ORD}a0", -F.col("count"))
        return Table(df, (f"{ORD}a0", f"{ORD}a1"), frozenset({"count"}))

    def window(self, by=(), order=(), **funcs: Win | Agg) -> Table:
        """Adds columns computed over partitions; rows and their order stay."""
        from millrace.operators.windows import over

        if not funcs:
            raise PlanError("window needs a function")
        if clash := set(funcs) & set(self.columns):
            raise PlanError(f"there is a column {', '.join(sorted(clash))} already")
        by = [by] if isinstance(by, str) else list(by)
        order = [order] if isinstance(order, (str, tuple, Column)) and order != () else list(order)
        t = self.numbered()
        part = Window.partitionBy(*map(_column, by))
        keys = [_ordered(k, "last") for k in order]
        frames = Frames(part.orderBy(*keys, *t._order()), part.orderBy(*(keys or [F.lit(1)])), part, Scope(None, t.known, t.types))
        built = {n: (f if isinstance(f, Win) else over(f)).build(frames) for n, f in funcs.items()}
        df = t.df.withColumns(built)
        return Table(df if self.ord else df.drop(*t.ord), self.ord, t.known)

    # -- shapes

    def unpivot(self, *columns: str, names: str = "name", values: str = "value") -> Table:
        """A row for each of the columns of each row."""
        self._known(*columns)
        if not columns or len(set(columns)) < len(columns):
            raise PlanError("unpivot takes columns, each once")
        if len({self.types[c] for c in columns}) > 1:
            raise PlanError("the columns have different types")
        ids = [c for c in self.columns if c not in columns]
        if names == values or {names, values} & set(ids):
            raise PlanError("the new names are taken")
        pairs = F.array(*(F.struct(F.lit(c).alias("n"), F.col(c).alias("v")) for c in columns))
        df = self.df.select(*ids, *self.ord, F.posexplode(pairs).alias(f"{ORD}ak", "__x"))
        order = (*self.ord, f"{ORD}ak") if self.ord else ()
        return Table(df.select(*ids, F.col("__x.n").alias(names), F.col("__x.v").alias(values), *order), order, self.known & set(ids))

    def explode(self, column: str, separator: str = ",") -> Table:
        """A row for each piece of a string, trimmed; null stays one row."""
        self._known(column)
        if self.types[column] != "string":
            raise PlanError("only strings can be exploded")
        pieces = F.transform(text.split(F.col(column), separator), lambda p: text.trim(p))
        df = self.df.select("*", F.posexplode_outer(pieces).alias(f"{ORD}ak", "__x")).withColumn(column, F.col("__x")).drop("__x")
        order = (*self.ord, f"{ORD}ak") if self.ord else ()
        return Table(df if order else df.drop(f"{ORD}ak"), order, self.known - {column})

    def pipe(self, f: Callable, *args, **options):
        """`f(self, ...)`; a function that names columns sees those of any table that has them."""
        return f(self, *args, **options)

    # -- actions

    def collect(self) -> Table:
        """Computed once; kept in memory and on disk, and computed again where an executor is lost."""
        return Table(self.df.persist(), self.ord, self.known)

    def count(self) -> int:
        return self.df.count()

    def to_rows(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.ordered().collect()]

    def explain(self) -> str:
        """The plan as written and as optimized; nothing runs."""
        execution = self.ordered()._jdf.queryExecution()
        return f"{execution.analyzed().toString()}\n{execution.optimizedPlan().toString()}"

    def assert_eq(self, other: Table) -> None:
        """Same columns, rows and order."""
        mine, theirs = self.to_rows(), other.to_rows()
        if self.columns != other.columns:
            raise AssertionError(f"columns differ: {self.columns} and {other.columns}")
        if [repr(r) for r in mine] != [repr(r) for r in theirs]:
            raise AssertionError(f"rows differ: {mine} and {theirs}")


class _Skipped(Table):
    """A table without its first rows, which are only cut when it is known what for."""

    def __init__(self, table: Table, n: int):
        self._table, self._n, self._cut = table, n, None

    def _rest(self) -> Table:
        if self._cut is None:
            t = self._table.row_numbers("__skip")
            self._cut = t._next(t.df.filter(F.col("__skip") >= self._n).drop("__skip"))
        return self._cut

    @property
    def df(self) -> DataFrame:
        return self._rest().df

    @property
    def ord(self) -> tuple[str, ...]:  # noqa: A003
        return self._rest().ord

    @property
    def known(self) -> frozenset[str]:
        return self._table.known

    def take(self, n: int) -> Table:
        if n < 0:
            raise PlanError("a number of rows is not negative")
        t = self._table.numbered()
        return t._next(t.df.orderBy(*t._order()).offset(self._n).limit(n))


class Grouped:
    """A table with keys; only `agg` and `pivot` take it."""

    def __init__(self, table: Table, keys: list[str]):
        self.table, self.keys = table, keys

    def _scoped(self, aggs: dict[str, Agg]) -> tuple[Table, Scope]:
        t = self.table
        if t.ord or any(a.ordered for a in aggs.values()):
            t = t.single_order()
        return t, Scope(F.col(t.ord[0]) if t.ord else None, t.known, t.types)

    def agg(self, **aggs: Agg) -> Table:
        """A row for each group, where it first appears (if a row order is known)."""
        if not aggs:
            raise PlanError("agg needs an aggregate")
        if clash := set(aggs) & set(self.keys):
            raise PlanError(f"{', '.join(sorted(clash))} is a key already")
        if bad := [n for n, a in aggs.items() if not isinstance(a, Agg)]:
            raise PlanError(f"{bad[0]} is not an aggregate")
        t, scope = self._scoped(aggs)
        built = [a.build(scope).alias(n) for n, a in aggs.items()]
        counts = {n for n, a in aggs.items() if a.counts}
        if not self.keys:
            return Table(t.df.agg(*built), (), frozenset(counts))
        first = [F.min(t.ord[0]).alias(f"{ORD}a0")] if t.ord else []
        df = t.df.groupBy(*self.keys).agg(*built, *first)
        return Table(df, (f"{ORD}a0",) if t.ord else (), frozenset(counts | (t.known & set(self.keys))))

    def pivot(self, column: str, values: list, **aggs: Agg) -> Table:
        """A column for each listed value (and aggregate, if there are several): v or v_name."""
        if not aggs or not values:
            raise PlanError("pivot needs values and an aggregate")
        if any(not a.pivots for a in aggs.values()):
            raise PlanError("first and last cannot be pivoted")
        self.table._known(column)
        t, scope = self._scoped(aggs)
        names = [str(v) if len(aggs) == 1 else f"{v}_{n}" for v in values for n in aggs]
        if len(set(names)) < len(names) or set(names) & set(self.keys):
            raise PlanError("two columns would have one name")
        # One aggregation with conditions: rows of other values are skipped, absent ones give null, and 0 for counts.
        built = []
        for v in values:
            for a in aggs.values():
                built.append(a.build(Scope(scope.order, frozenset(), scope.types, F.col(column) == F.lit(v))))
        df = t.df.groupBy(*self.keys).agg(*(b.alias(n) for b, n in zip(built, names, strict=True)), *([F.min(t.ord[0]).alias(f"{ORD}a0")] if t.ord else []))
        return Table(df, (f"{ORD}a0",) if t.ord else (), t.known & set(self.keys))


__all__ = ["Grouped", "PlanError", "Table", "asc", "desc"]
