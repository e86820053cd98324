import pytest
from pyspark.sql import functions as F

from millrace.functions import convert, dates, durations, hashing, lists, null, regex, text
from millrace.functions import math as m
from millrace.operators import PlanError, Table, desc, stats
from millrace.operators import aggregates as a
from millrace.operators import windows as w

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def t(spark):
    rows = [("a", 1, 2.0, "x, y"), ("b", 5, None, None), ("a", 4, 7.5, "z"), ("a", 2, 4.5, " q ,r"), ("b", 4, 1.0, "")]
    return Table.from_rows(spark, [dict(zip(("g", "x", "y", "s"), r, strict=True)) for r in rows], "g string, x bigint, y double, s string")


def one(spark, expr, **values):
    """The value of an expression over one row of values."""
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "z bigint"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(expr.alias("r")).first()["r"]


def test_order_is_kept(t):
    assert [r["x"] for r in t.where(F.col("x") > 1).to_rows()] == [5, 4, 2, 4]
    assert [r["x"] for r in t.sort("g").to_rows()] == [1, 4, 2, 5, 4]
    assert [r["y"] for r in t.sort(desc("y")).to_rows()] == [7.5, 4.5, 2.0, 1.0, None]
    assert [r["y"] for r in t.sort("y", nulls="first").to_rows()] == [None, 1.0, 2.0, 4.5, 7.5]
    assert [r["x"] for r in t.take(2).to_rows()] == [1, 5]
    assert [r["x"] for r in t.skip(3).to_rows()] == [2, 4]
    assert [r["x"] for r in t.tail(2).to_rows()] == [2, 4]
    assert [r["x"] for r in t.sort(desc("x")).tail(2).to_rows()] == [2, 1]
    assert [r["g"] for r in t.distinct("g").to_rows()] == ["a", "b"]
    assert t.count_by("g").to_rows() == [{"g": "a", "count": 3}, {"g": "b", "count": 2}]
    assert [r["x"] for r in t.union(t.take(1)).to_rows()] == [1, 5, 4, 2, 4, 1]


def test_groups(t):
    rows = t.group("g").agg(n=a.count(), f=a.first("y"), l=a.last("x"), top=a.arg_max("x", "x"), s=a.string_agg("g", "-"), total=a.sum_("x")).to_rows()
    assert rows == [
        {"g": "a", "n": 3, "f": 2.0, "l": 2, "top": 4, "s": "a-a-a", "total": 7},
        {"g": "b", "n": 2, "f": None, "l": 4, "top": 5, "s": "b-b", "total": 9},
    ]
    assert t.agg(r=a.sum_("x").with_(a.count(), lambda s, n: s / n)).to_rows() == [{"r": 3.2}]
    assert t.group("g").pivot("x", [4, 9], n=a.count()).to_rows() == [{"g": "a", "4": 1, "9": 0}, {"g": "b", "4": 1, "9": 0}]


def test_first_tie_wins(spark):
    ties = Table.from_rows(spark, [{"k": i, "v": 1} for i in range(5)], "k bigint, v bigint")
    assert ties.agg(hi=a.arg_max("k", "v"), lo=a.arg_min("k", "v")).to_rows() == [{"hi": 0, "lo": 0}]


def test_sum_overflows_only_in_the_end(spark):
    big = (1 << 63) - 1
    t = Table.from_rows(spark, [{"n": big}, {"n": 1}, {"n": -1}], "n bigint")
    assert t.agg(s=a.sum_("n")).to_rows() == [{"s": big}]
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        t.take(2).agg(s=a.sum_("n")).to_rows()


def test_empty_sums(t):
    none = t.declare("x").where(F.col("x") > 99)
    assert none.agg(known=a.sum_("x"), maybe=a.sum_("y"), n=a.count()).to_rows() == [{"known": 0, "maybe": None, "n": 0}]


def test_joins(spark):
    left = Table.from_rows(spark, [{"k": k, "a": i} for i, k in enumerate([1, 2, None, 2])], "k bigint, a bigint")
    right = Table.from_rows(spark, [{"k": k, "b": i} for i, k in enumerate([2, 3, None])], "k bigint, b bigint")
    assert [(r["k"], r["a"], r["b"]) for r in left.join(right, on="k").to_rows()] == [(2, 1, 0), (2, 3, 0)]
    assert [(r["k"], r["b"]) for r in left.join(right, on="k", how="left").to_rows()] == [(1, None), (2, 0), (None, None), (2, 0)]
    assert [(r["k"], r["a"]) for r in left.join(right, on="k", how="right").to_rows()] == [(2, 1), (2, 3), (3, None), (None, None)]
    full = left.join(right, on="k", how="full").to_rows()
    assert [(r["k"], r["a"], r["b"]) for r in full] == [(1, 0, None), (2, 1, 0), (None, 2, None), (2, 3, 0), (3, None, 1), (None, None, 2)]
    assert [r["a"] for r in left.join(right, on="k", how="semi").to_rows()] == [1, 3]
    assert [r["a"] for r in left.join(right, on="k", how="anti").to_rows()] == [0, 2]
    assert len(left.join(right.rename(j="k"), how="cross").to_rows()) == 12


def test_sets(spark):
    left = Table.from_rows(spark, [{"k": 1, "s": None}, {"k": 2, "s": "x"}, {"k": 1, "s": None}], "k bigint, s string")
    right = Table.from_rows(spark, [{"s": None, "k": 1}], "s string, k bigint")
    assert left.intersect(right).to_rows() == [{"k": 1, "s": None}]
    assert left.except_(right).to_rows() == [{"k": 2, "s": "x"}]


def test_windows(t):
    rows = t.window(by="g", order="x", n=w.row_number(), before=w.lag("x"), run=w.cumsum("x"), fill=w.fill_forward("y"), top=a.max_("x")).to_rows()
    assert [(r["x"], r["n"], r["before"], r["run"], r["fill"], r["top"]) for r in rows] == [
        (1, 1, None, 1, 2.0, 4), (5, 2, 4, 9, 1.0, 5), (4, 3, 2, 7, 7.5, 4), (2, 2, 1, 3, 4.5, 4), (4, 1, None, 4, 1.0, 5),
    ]
    assert [r["r"] for r in t.window(r=w.rank()).to_rows()] == [1] * 5


def test_shapes(t):
    assert [(r["x"], r["s"]) for r in t.explode("s").select("x", "s").to_rows()] == [(1, "x"), (1, "y"), (5, None), (4, "z"), (2, "q"), (2, "r"), (4, "")]
    wide = t.take(1).derive(z=F.col("x") + 1).unpivot("x", "z", names="n", values="v").to_rows()
    assert [(r["n"], r["v"]) for r in wide] == [("x", 1), ("z", 2)]
    assert t.sample(3).to_rows() == t.sample(3).to_rows() and len(t.sample(3).to_rows()) == 3
    assert [r["x"] for r in t.drop_nulls("y").to_rows()] == [1, 4, 2, 4]
    assert [r["y"] for r in t.fill_nulls(y=0.0).to_rows()] == [2.0, 0.0, 7.5, 4.5, 1.0]


def test_stats(t):
    rows = {r["column"]: r for r in stats.describe(t).collect()}
    assert (rows["x"]["mean"], rows["x"]["median"], rows["y"]["nulls"], rows["g"]["mean"]) == (3.2, 4.0, 1, None)
    bins = sorted(stats.histogram(t, "x", 4).collect())
    assert [(b["low"], b["high"], b["count"]) for b in bins] == [(1.0, 2.0, 1), (2.0, 3.0, 1), (3.0, 4.0, 0), (4.0, 5.0, 3)]
    line = stats.linreg(t, "y", "x").first()
    assert 0 <= line["r2"] <= 1


@pytest.mark.parametrize(
    "wrong",
    [
        lambda t: t.where(F.col("x")), lambda t: t.select("x", x=F.col("y")), lambda t: t.select(), lambda t: t.drop("g", "x", "y", "s"), lambda t: t.rename(x="y"),
        lambda t: t.derive(), lambda t: t.sort(), lambda t: t.sort("x", nulls="middle"), lambda t: t.take(-1), lambda t: t.group(), lambda t: t.group("g", "g"),
        lambda t: t.group("g").agg(), lambda t: t.group("g").agg(g=a.count()), lambda t: t.group("g").agg(n=F.count("x")), lambda t: t.window(x=w.rank()), lambda t: t.window(),
        lambda t: t.window(c=a.corr("x", "y")), lambda t: t.join(t, on="g"), lambda t: t.join(t, how="cross", on="g"), lambda t: t.join(t, left_on="g", right_on="x"),
        lambda t: t.union(t.drop("x")), lambda t: t.group("g").pivot("x", [1], f=a.first("x")), lambda t: t.unpivot("x", "y"), lambda t: t.explode("x"), lambda t: t.sample(),
        lambda t: t.sample(n=1, fraction=0.5), lambda t: t.sample(fraction=2.0), lambda t: t.select("nothing"), lambda t: t.rename(count="x").count_by("count"), lambda t: a.quantile("x", 2.0),
        lambda t: t.window(order="x", r=w.lag("x", 0)).plain(),
    ],
)
def test_mistakes_are_found_early(t, wrong):
    with pytest.raises((PlanError, ValueError)):
        wrong(t)


def test_numbers(spark):
    x = F.col("x")
    for value, digits, want in ((2.345, 2, 2.35), (0.285, 2, 0.28), (1.005, 2, 1.0), (-2.5, 0, -3.0), (1e300, 2, 1e300)):
        assert one(spark, m.fround(x, digits), x=value) == want
    assert one(spark, m.fdiv(x, F.lit(0)), x=-1.0) == -INF and str(one(spark, m.fdiv(x, F.lit(0)), x=0.0)) == "nan"
    assert one(spark, m.fdiv(F.lit(2), x), x=-0.0) == -INF and one(spark, m.fdiv(F.lit(-2), x), x=-0.0) == INF and one(spark, m.fdiv(x, F.lit(0)), x=INF) == INF
    assert one(spark, m.ln(x), x=0.0) == -INF and one(spark, m.log(x, 3), x=81.0) == pytest.approx(4)
    assert one(spark, m.div(x, F.lit(2)), x=-7) == -3 and one(spark, m.trunc(x, 1), x=-1.29) == -1.2
    with pytest.raises(Exception, match="ZERO"):
        one(spark, m.div(x, F.lit(0)), x=7)
    assert one(spark, m.is_finite(x), x=INF) is False and one(spark, m.is_nan(x), x=NAN) is True


def test_nulls(spark):
    x = F.col("x")
    assert one(spark, null.greatest(x, F.lit(None)), x=1) is None and one(spark, null.clamp(x, 2, 3), x=1) == 2
    assert one(spark, null.is_in(x, [2, None]), x=1) is None and one(spark, null.is_in(x, []), x=1) is False
    assert one(spark, null.match(null.null_if(x, 1), {None: "none", 2: "two"}, "more"), x=1) == "none"


def test_strings(spark):
    s = F.col("s")
    cases = [
        (text.substring(s, -9, 2), "hello", "he"), (text.substring(s, 1), "hello", "ello"), (text.pad_left(s, 3), "hello", "hello"), (text.title(s), "world-wide 2nd", "World-Wide 2nd"),
        (text.trim(s), "  x \t", "x"), (text.split_part(s, ".", -1), "a.b", "b"), (text.split_part(s, ".", 5), "a.b", None), (text.index_of(s, "l"), "hello", 2), (text.index_of(s, "z"), "hello", None),
        (text.replace(s, "", "x"), "ab", "ab"), (text.left(s, -1), "ab", ""), (text.reverse(s), "añb", "bña"), (regex.regex_extract(s, "b(c)?", 1), "ab", None), (regex.regex_extract(s, "x"), "ab", None),
        (regex.regex_replace(s, "(?P<n>b)", "[${n}$$]"), "ab", "a[b$]"), (regex.regex_count(s, "l"), "hello", 2), (convert.parse_number(s), "1,234.5", 1234.5), (convert.parse_number(s), "(120)", -120.0),
        (convert.parse_number(s), "45%", 0.45), (convert.parse_number(s), "1,,2", None), (convert.try_to_int(s), "1,200", None), (convert.to_bool(s), " Yes", True), (convert.try_to_bool(s), "maybe", None),
        (convert.try_to_date(s), "2024-2-1", None),
    ]
    for expr, value, want in cases:
        assert one(spark, expr, s=value) == want, (value, want)
    x = F.col("x")
    assert one(spark, text.format_number(x, 1), x=-1234567.25) == "-1,234,567.3"
    assert one(spark, text.format_number(x, 0), x=-0.4) == "0" and one(spark, text.format_number(x, 2, " "), x=1234.5) == "1 234.50"
    assert one(spark, text.format_percent(x, 1), x=0.256) == "25.6%"
    assert one(spark, text.format_percent(x, 0), x=-0.0) == "0%" and one(spark, text.format_number(x, 1, zero_sign=True), x=0.0) == "0.0"
    assert one(spark, text.format_number(x, 1), x=1e23) == "99,999,999,999,999,991,611,392.0"
    with pytest.raises(ValueError):
        regex.regex_match(s, "a(?=b)")


def test_dates(spark):
    d = lambda v: F.lit(v).cast("date")
    ts = lambda v: F.lit(v).cast("timestamp_ntz")
    cases = [
        (dates.months_between(d("2024-01-31"), d("2024-02-29")), 1), (dates.months_between(d("2024-02-29"), d("2024-01-31")), -1), (dates.years_between(d("2020-02-29"), d("2023-02-28")), 3),
        (dates.weekday(d("2024-01-07")), 7), (dates.fiscal_year(d("2024-10-01"), 10), 2025), (dates.buddhist_year(d("2024-10-01")), 2567), (dates.format_date(d("2024-03-05"), "%d %B %Y at 'x'"), "05 March 2024 at 'x'"),
        (dates.format_date(d("2024-03-05"), "%Y-%y", era="buddhist"), "2567-67"), (dates.to_unix(ts("1969-12-31 23:59:59.5")), -1), (durations.total_seconds(durations.hours(F.lit(1.5))), 5400.0),
        (durations.to_text(durations.seconds(F.lit(-93784.5))), "-1d 02:03:04.5"), (convert.to_string(ts("2026-01-05 09:00:00"), "timestamp_ntz"), "2026-01-05T09:00:00"),
        (convert.to_string(F.lit("1.500000").cast("decimal(38,6)"), "decimal(38,6)"), "1.5"),
    ]
    for expr, want in cases:
        assert one(spark, expr) == want, want
    with pytest.raises(ValueError):
        dates.format_date(d("2024-01-01"), "%Z")


def test_stable_hash(spark):
    def mix(v):
        v = ((v ^ (v >> 30)) * hashing.MIX_A) & hashing.MASK
        v = ((v ^ (v >> 27)) * hashing.MIX_B) & hashing.MASK
        return v ^ (v >> 31)

    x = F.col("x")
    for value in (0, 1, -5, 1 << 40):
        assert one(spark, hashing.stable_hash(x, "bigint", 3), x=value) == mix((value & hashing.MASK) ^ mix((3 + hashing.GOLDEN) & hashing.MASK)) >> 1
    assert one(spark, hashing.stable_hash(x, "double"), x=0.0) == one(spark, hashing.stable_hash(x, "double"), x=-0.0)


def test_lists(spark):
    xs = F.array(F.lit(3), F.lit(1), F.lit(2))
    m_ = F.create_map(F.lit("a"), F.lit(1))
    cases = [
        (lists.sort(xs, down=True), [3, 2, 1]), (lists.sort_by(xs, lambda x: -x), [3, 2, 1]), (lists.index_of(xs, 1), 1), (lists.skip(xs, 2), [2]), (lists.take(xs, 2), [3, 1]), (lists.mean(xs), 2.0),
        (lists.find(xs, lambda x: x < 3), 1), (lists.count(xs, lambda x: x > 1), 2), (lists.put(m_, "a", F.lit(2)), {"a": 2}), (lists.remove(m_, "a"), {}), (lists.has_key(m_, "b"), False),
    ]
    for expr, want in cases:
        assert one(spark, expr) == want


def test_one_clock_and_records(spark):
    assert one(spark, dates.now()) == dates.clock() and one(spark, dates.today()) == dates.clock().date()
    assert one(spark, lists.with_field(F.struct(F.lit(1).alias("a")), "b", F.lit(2))).asDict() == {"a": 1, "b": 2}


def test_row_numbers_of_wide_rows_are_gapless(spark, tmp_path):
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = Table(spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")).sort(desc("l_shipdate"), *keys)
    numbered = t.row_numbers("k")
    numbered.plain().write.parquet(f"{tmp_path}/numbered")
    found = spark.read.parquet(f"{tmp_path}/numbered").agg(F.count_distinct("k"), F.min("k"), F.max("k"), F.count("k")).first()
    n = t.count()
    assert tuple(found) == (n, 0, n - 1, n)


def test_sample_does_not_depend_on_other_columns(spark):
    t = Table(spark.range(20_000, numPartitions=6).select("id", (F.col("id") * 7919 % 1000).alias("v"), F.lit("x" * 50).alias("wide"))).sort("v", "id")
    rows = lambda x: {r["id"] for r in x.sample(n=200, seed=1).to_rows()}
    assert rows(t) == rows(t.drop("wide")) and len(rows(t)) == 200


def test_skip_then_take_and_skip_alone(spark):
    t = Table(spark.range(500, numPartitions=5)).sort(desc("id"))
    assert [r["id"] for r in t.skip(10).take(3).to_rows()] == [489, 488, 487]
    assert [r["id"] for r in t.skip(497).to_rows()] == [2, 1, 0]
    assert t.skip(600).to_rows() == []
