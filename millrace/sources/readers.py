"""Readers: columns by name, in the declared types; bad values are errors, extra columns are skipped."""

from __future__ import annotations

import glob as globbing
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.table import PlanError, Table

#: Short type names and Spark's.
TYPES = {
    "int": "bigint", "float": "double", "bool": "boolean", "string": "string", "date": "date",
    "datetime": "timestamp_ntz", "duration": "interval day to second", "decimal": "decimal(38,6)",
}
RowType = dict[str, str]


def spark_type(name: str) -> tuple[str, bool]:
    """Spark's type of a declared one, and whether it may be missing (`int?`)."""
    bare = name.removesuffix("?")
    if bare not in TYPES:
        raise PlanError(f"{name} cannot be a column's type")
    return TYPES[bare], name.endswith("?")


def files_of(path: str) -> str | list[str]:
    """Files that a local pattern names, in name order; other addresses are left to Spark."""
    if "://" in path or not any(c in path for c in "*?["):
        return path
    found = sorted(globbing.glob(path, recursive=True))
    if not found:
        raise FileNotFoundError(f"no file matches {path}")
    return found


def _shaped(df: DataFrame, row: RowType, file_name: str | None, nulls: list[str] = (), empty_is_null: bool = False) -> Table:
    """The declared columns, cast, with checks that what must be there is."""
    missing = [c for c in row if c not in df.columns]
    if missing:
        raise PlanError(f"the file has no column {missing[0]}; it has: {', '.join(df.columns)}")
    out, known = [], set()
    for name, declared in row.items():
        kind, optional = spark_type(declared)
        c = F.col(f"`{name}`")
        is_text = dict(df.dtypes)[name] == "string"
        if is_text and not (kind == "string" and not optional):
            if nulls:
                c = F.when(c.isin(*nulls), None).otherwise(c)
            if empty_is_null:
                c = F.when(c == "", None).otherwise(c)
        if is_text and kind == "string" and not optional and empty_is_null:
            c = F.coalesce(c, F.lit(""))
        if kind.startswith("interval") and is_text:
            c = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))
        c = c.cast(kind)
        if not optional:
            c = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"missing value in {name}, which is declared never to be")).cast(kind))
            known.add(name)
        out.append(c.alias(name))
    if file_name:
        out.append(F.input_file_name().alias(file_name))
        known.add(file_name)
    return Table(df.select(*out), (), frozenset(known))


def read_csv(spark: SparkSession, path: str, row: RowType, delimiter: str = ",", encoding: str = "utf-8", header: bool = True, skip: int = 0, nulls: list[str] = (), file_name: str | None = None) -> Table:
    """Comma-separated text. Without a header, columns are by position; `skip` lines come before it."""
    files = files_of(path)
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("escape", '"').option("quote", '"').option("mode", "FAILFAST").option("multiLine", "true")
    reader = reader.option("emptyValue", "").option("nullValue", "\0")
    if skip:
        first = files if isinstance(files, str) else files[0]
        with open(first, encoding=encoding) as f:
            head = [f.readline() for _ in range(skip + 1)]
        import csv

        names = next(csv.reader([head[skip].rstrip("\r\n")], delimiter=delimiter))
        width = len(names)
        names = names if header else [f"c{i}" for i in range(width)]
        lines = spark.read.option("encoding", encoding).text(files).withColumn("n", F.monotonically_increasing_id() % (1 << 33))
        body = lines.filter(F.col("n") >= skip + header).select("value")
        schema = T.StructType([T.StructField(n.strip(), T.StringType()) for n in names])
        parsed = body.select(F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": delimiter, "emptyValue": ""}).alias("r")).select("r.*")
        return _shaped(parsed if header else parsed.toDF(*list(row)[:width]), row, file_name, list(nulls), True)
    df = reader.option("header", str(header).lower()).csv(files)
    df = df.toDF(*(c.strip() for c in df.columns)) if header else df.toDF(*[*row, *(f"__extra{i}" for i in range(len(df.columns) - len(row)))])
    return _shaped(df, row, file_name, list(nulls), True)


def read_parquet(spark: SparkSession, path: str, row: RowType | None = None, file_name: str | None = None) -> Table:
    """Parquet; without a row type, all columns as they are."""
    df = spark.read.parquet(*([f] if isinstance(f := files_of(path), str) else f))
    return Table(df) if row is None else _shaped(df, row, file_name)


def read_json(spark: SparkSession, path: str, row: RowType, file_name: str | None = None) -> Table:
    """JSON Lines, or one array; told apart by the first character of the text."""
    files = files_of(path)
    schema = T.StructType([T.StructField(n, T.StringType() if spark_type(t)[0] not in ("string",) else T.StringType()) for n, t in row.items()])
    head = spark.read.text(files, wholetext=False).filter(F.trim("value") != "").limit(1).collect()
    array = bool(head) and head[0][0].lstrip().startswith("[")
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(array).lower()).json(files)
    return _shaped(df, row, file_name)


def read_orc(spark: SparkSession, path: str, row: RowType | None = None) -> Table:
    df = spark.read.orc(files_of(path))
    return Table(df) if row is None else _shaped(df, row, None)


def read_sql(spark: SparkSession, address: str, query: str, row: RowType) -> Table:
    """Any SELECT: of a SQLite file, or of a server by its postgres:// or mysql:// address (its JDBC driver must be there)."""
    if address.startswith(("postgres://", "postgresql://", "mysql://")):
        kind, rest = address.split("://", 1)
        url = f"jdbc:{'mysql' if kind == 'mysql' else 'postgresql'}://{rest.rpartition('@')[2]}"
        options = {}
        if "@" in rest:
            user, _, password = rest.rpartition("@")[0].partition(":")
            options = {"user": user, "password": password}
        return _shaped(spark.read.jdbc(url, f"({query}) AS t", properties=options), row, None)
    from millrace.sources.sqlite import SqliteSource

    if not os.path.exists(address):
        raise FileNotFoundError(address)
    spark.dataSource.register(SqliteSource)
    schema = ", ".join(f"`{n}` string" for n in row)
    df = spark.read.format("millrace_sqlite").schema(schema).option("path", os.path.abspath(address)).option("query", query).load()
    return _shaped(df, row, None)


def read_excel(spark: SparkSession, path: str, row: RowType, sheet: str | None = None, cells: str | None = None, skip: int = 0, header: bool = True, nulls: list[str] = (), file_name: str | None = None) -> Table:
    """One sheet of a workbook. A workbook is one file of bounded size (a sheet has at most 2^20 rows)."""
    from millrace.sources.excel import sheet_rows

    frames = []
    for f in [files] if isinstance(files := files_of(path), str) else files:
        rows = sheet_rows(f, sheet, cells)[skip:]
        names = [str(c).strip() if c is not None else "" for c in rows[0]] if header and rows else list(row)
        body = rows[1:] if header else rows
        for r in body:
            if any(v is not None for v in r):
                frames.append([r[names.index(c)] if c in names and names.index(c) < len(r) else None for c in row] + [f])
        if missing := [c for c in row if c not in names]:
            raise PlanError(f"the sheet has no column {missing[0]}; it has: {', '.join(names)}")
    schema = ", ".join(f"`{n}` string" for n in row) + ", __file string"
    df = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in frames], schema)
    table = _shaped(df.drop("__file") if not file_name else df.withColumnRenamed("__file", file_name), row | ({file_name: "string"} if file_name else {}), None, list(nulls))
    return table
