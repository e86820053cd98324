"""Row types of files, from a sample of their first rows."""

from __future__ import annotations

import csv
import re

from pyspark.sql import SparkSession

SAMPLE = 10_000
_KINDS = (
    ("int", re.compile(r"[+-]?(0|[1-9]\d*)")),
    ("float", re.compile(r"[+-]?(0|[1-9]\d*)?\.?\d+([eE][+-]?\d+)?|[+-]?\d+\.")),
    ("bool", re.compile("true|false", re.I)),
    ("date", re.compile(r"\d{4}-\d{2}-\d{2}")),
    ("datetime", re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?")),
)


def kind_of(values: list[str]) -> str:
    """The narrowest type that all values have; numbers with leading zeros stay text."""
    some = [v.strip() for v in values if v.strip()]
    optional = "?" if len(some) < len(values) else ""
    if not some:
        return "string?"
    for kind, pattern in _KINDS:
        if all(pattern.fullmatch(v) for v in some):
            if kind == "float" and any(re.fullmatch(r"[+-]?0\d+", v) for v in some):
                continue
            return kind + optional
    return "string" + optional


def delimiter_of(line: str) -> str:
    """The separator that is most frequent in the header."""
    return max(",\t;|", key=lambda d: (line.count(d), d == ","))


def infer_csv(path: str, encoding: str = "utf-8") -> tuple[dict[str, str], str]:
    """Row type and delimiter."""
    with open(path, encoding=encoding, newline="") as f:
        delimiter = delimiter_of(f.readline())
        f.seek(0)
        rows = csv.reader(f, delimiter=delimiter)
        names = next(rows)
        sample = [r for _, r in zip(range(SAMPLE), rows, strict=False)]
    return {n: kind_of([r[i] if i < len(r) else "" for r in sample]) for i, n in enumerate(names)}, delimiter


def infer_parquet(spark: SparkSession, path: str) -> dict[str, str]:
    kinds = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "boolean": "bool", "string": "string", "date": "date", "timestamp_ntz": "datetime", "timestamp": "datetime"}
    found = {}
    for f in spark.read.parquet(path).schema.fields:
        kind = f.dataType.simpleString()
        name = "decimal" if kind.startswith("decimal") else kinds.get(kind)
        if name:
            found[f.name] = name + ("?" if f.nullable else "")
    return found


def infer_json(spark: SparkSession, path: str) -> dict[str, str]:
    sample = spark.read.option("primitivesAsString", "true").json(path).limit(SAMPLE).collect()
    names = sample[0].asDict() if sample else {}
    return {n: kind_of([r[n] if isinstance(r[n], str) else "" for r in sample]) for n in names if all(r[n] is None or isinstance(r[n], str) for r in sample)}
