"""Descriptive statistics of tables, each from one aggregation over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import aggregates
from millrace.operators.table import PlanError, Table

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _is_number(kind: str) -> bool:
    return kind.startswith(NUMBERS)


def describe(t: Table) -> DataFrame:
    """A row for each column: column, type, count, nulls, mean, stddev, min, median, max (the last five of numbers)."""
    aggs, rows = [], []
    for i, (name, kind) in enumerate(t.types.items()):
        x = F.col(name).cast("double")
        aggs += [F.count(name).alias(f"c{i}"), F.count_if(F.col(name).isNull()).alias(f"n{i}")]
        if _is_number(kind):
            aggs += [of(x).alias(f"{k}{i}") for k, of in (("m", F.avg), ("s", F.stddev_samp), ("l", F.min), ("d", F.median), ("h", F.max))]
        value = lambda k, i=i, kind=kind: F.col(f"{k}{i}") if _is_number(kind) else F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(name).alias("column"), F.lit(kind).alias("type"), F.col(f"c{i}").alias("count"), F.col(f"n{i}").alias("nulls"),
                value("m").alias("mean"), value("s").alias("stddev"), value("l").alias("min"), value("d").alias("median"), value("h").alias("max"),
            )
        )
    return t.plain().agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histogram(t: Table, column: str, bins: int = 10) -> DataFrame:
    """bin, low, high, count: equal widths between least and largest value, the largest in the last; one bin if all are equal."""
    if bins < 1:
        raise PlanError("a histogram has a bin")
    if not _is_number(t.types.get(column, "")):
        raise PlanError("a histogram is of numbers")
    df = t.plain().select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = df.agg(F.min("x").alias("low"), F.max("x").alias("top"))  # one row
    ends = ends.filter("low IS NOT NULL").withColumn("n", F.when(F.col("low") == F.col("top"), 1).otherwise(bins)).withColumn("width", (F.col("top") - F.col("low")) / F.col("n"))
    place = F.when(F.col("width") == 0, 0).otherwise(F.least(F.floor((F.col("x") - F.col("low")) / F.nullif("width", F.lit(0.0))), F.col("n") - 1)).cast("bigint")
    counts = df.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = ends.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("bin"), "low", "top", "width", "n")
    joined = edges.join(counts, "bin", "left")
    return joined.select(
        "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"),
        F.when(F.col("bin") == F.col("n") - 1, F.col("top")).otherwise(F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )


def linreg(t: Table, y: str, x: str) -> DataFrame:
    """One row: slope, intercept, r2 of the least-squares line of y over x."""
    r = aggregates.corr(y, x)
    return t.agg(slope=aggregates.slope(y, x), intercept=aggregates.intercept(y, x), r2=r.then(lambda c: c * c)).plain()
