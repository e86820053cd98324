"""Conversions: the plain ones fail on bad input (ANSI casts), those named try give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE, FALSE = ("t", "true", "y", "yes", "1"), ("f", "false", "n", "no", "0")


def to_int(x: Column) -> Column:
    return x.cast("bigint")


def to_float(x: Column) -> Column:
    return x.cast("double")


def to_decimal(x: Column) -> Column:
    return x.cast("decimal(38,6)")


def to_date(x: Column) -> Column:
    return x.cast("date")


def to_datetime(x: Column) -> Column:
    return x.cast("timestamp_ntz")


def try_to_int(x: Column) -> Column:
    return x.try_cast("bigint")


def try_to_float(x: Column) -> Column:
    return x.try_cast("double")


def try_to_decimal(x: Column) -> Column:
    return x.try_cast("decimal(38,6)")


def try_to_date(x: Column) -> Column:
    """Of text, only YYYY-MM-DD."""
    text = x.cast("string")
    return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), F.trim(text).try_cast("date"))


def try_to_datetime(x: Column) -> Column:
    return x.try_cast("timestamp_ntz")


def _truth(x: Column) -> Column:
    word = F.lower(F.trim(x.cast("string")))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def try_to_bool(x: Column) -> Column:
    return _truth(x)


def to_bool(x: Column) -> Column:
    """Fails on a value that is no truth value."""
    truth = _truth(x)
    return F.when(x.isNull(), F.lit(None).cast("boolean")).when(truth.isNotNull(), truth).otherwise(
        F.raise_error(F.concat(F.lit("cannot convert to a bool: "), x.cast("string"))).cast("boolean")
    )


def parse_number(text: Column) -> Column:
    """Numbers as people write them: thousands commas, a percent sign, parentheses for negative; else null."""
    t = F.trim(text)
    negative = t.rlike(r"^\(.*\)$")
    inner = F.trim(F.when(negative, F.regexp_extract(t, r"^\((.*)\)$", 1)).otherwise(t))
    percent = inner.rlike("%$")
    bare = F.trim(F.regexp_replace(inner, "%$", ""))
    good = bare.rlike(r"^[+-]?(\d{1,3}(,\d{3})+|\d+)?(\.\d*)?([eE][+-]?\d+)?$") & bare.rlike(r"\d") & ~(negative & bare.rlike("^[+-]"))
    value = F.regexp_replace(bare, ",", "").try_cast("double")
    scaled = F.when(percent, value / 100).otherwise(value)
    return F.when(good, F.when(negative, -scaled).otherwise(scaled))


def to_string(x: Column, kind: str) -> Column:
    """The text of a value of the Spark type `kind`, as `print` shows it."""
    if kind.startswith("decimal"):
        text = x.cast("string")
        return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")).otherwise(text)
    if kind.startswith("timestamp"):
        whole = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
        part = F.regexp_replace(F.date_format(x, "SSSSSS"), "0+$", "")
        return F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    if kind.startswith("interval"):
        from millrace.functions.durations import to_text

        return to_text(x)
    if kind in ("double", "float"):
        return _float_text(x.cast("double"))
    return x.cast("string")


def _float_text(x: Column) -> Column:
    """Plain digits where the shortest form has up to 16, else with an exponent."""
    text = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), "0+$", ""), "\\.$", ".0")
    return (
        F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
        .when(text.contains("E") & (F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(text)
    )
