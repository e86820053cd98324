"""Strings, by Unicode code point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.convert import to_string
from millrace.functions.math import WHOLE, fround

#: Characters that padding and repeating may make.
MOST = 1_000_000
#: Numbers up to its square have exact digits.
EXACT = float(1 << 63)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def length(s: Column) -> Column:
    return F.char_length(s).cast("bigint")


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def trim(s: Column, chars: str | None = None) -> Column:
    return F.btrim(s, F.lit(chars)) if chars is not None else F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def trim_left(s: Column, chars: str | None = None) -> Column:
    return F.ltrim(s, F.lit(chars)) if chars is not None else F.regexp_replace(s, r"(?U)^\s+", "")


def trim_right(s: Column, chars: str | None = None) -> Column:
    return F.rtrim(s, F.lit(chars)) if chars is not None else F.regexp_replace(s, r"(?U)\s+$", "")


def contains(s: Column, part) -> Column:
    return s.contains(_col(part))


def starts_with(s: Column, part) -> Column:
    return s.startswith(_col(part))


def ends_with(s: Column, part) -> Column:
    return s.endswith(_col(part))


def index_of(s: Column, part) -> Column:
    """Position from 0 of the first occurrence, null if there is none; an empty part is at 0."""
    p = _col(part)
    return F.when(p == "", F.when(s.isNotNull(), F.lit(0))).otherwise(F.nullif(F.position(p, s), F.lit(0)) - 1).cast("bigint")


def substring(s: Column, start: int | Column, size: int | Column | None = None) -> Column:
    """From position `start` (from 0; negative counts from the end and stops at the beginning)."""
    at, n = _col(start), F.char_length(s)
    first = F.when(at < 0, F.greatest(n + at, F.lit(0))).otherwise(at).cast("int")
    most = n if size is None else F.greatest(_col(size), F.lit(0)).cast("int")
    return F.when(at.isNotNull(), F.substring(s, first + 1, most))


def left(s: Column, n) -> Column:
    return F.substring(s, F.lit(1), F.greatest(_col(n), F.lit(0)).cast("int"))


def right(s: Column, n) -> Column:
    k = F.least(F.greatest(_col(n), F.lit(0)).cast("int"), F.char_length(s))
    return F.substring(s, F.char_length(s) - k + 1, k)


def replace(s: Column, old, new) -> Column:
    o = _col(old)
    return F.when(o == "", s).otherwise(F.replace(s, o, _col(new)))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split(s: Column, separator: str) -> Column:
    """The pieces as an array; an empty separator gives the whole."""
    return F.split(s, _quoted(separator), -1) if separator else F.when(s.isNotNull(), F.array(s))


def split_part(s: Column, separator: str, n: int) -> Column:
    """Piece n from 0, negative from the end; null where there is none."""
    return F.try_element_at(split(s, separator), F.lit(n + 1 if n >= 0 else n))


def pad_left(s: Column, width: int, fill: str = " ") -> Column:
    """Never cuts."""
    return F.when(F.char_length(s) >= width, s).otherwise(F.lpad(s, _checked(width), fill))


def pad_right(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.char_length(s) >= width, s).otherwise(F.rpad(s, _checked(width), fill))


def _checked(width: int) -> int:
    if width > MOST:
        raise ValueError(f"a width of {width} is above {MOST}")
    return width


def repeat(s: Column, n: int) -> Column:
    return F.when(F.char_length(s) * max(n, 0) > MOST, F.raise_error(F.lit(f"repeat makes more than {MOST} characters")).cast("string")).otherwise(F.repeat(s, max(n, 0)))


def reverse(s: Column) -> Column:
    return F.reverse(s)


def title(s: Column) -> Column:
    """Each run of letters and digits begins with a capital."""
    runs = F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.char_length(w))))
    return F.array_join(F.transform(runs, cap), "")


def concat(*values: tuple[Column, str] | Column) -> Column:
    """All values as text, nulls left out; give (column, type) for what is not a string. Never null."""
    return F.concat_ws("", *(to_string(*v) if isinstance(v, tuple) else v.cast("string") for v in values))


def like(s: Column, pattern: str) -> Column:
    return s.like(pattern)


def _grouped(whole: Column, separator: str) -> Column:
    spaced = F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1" + separator.replace("\\", "\\\\").replace("$", "\\$"))
    return spaced if separator else whole


def _digits(size: Column, shortest: Column) -> Column:
    """The digits before the point; from 2^53 to 2^126 those of the exact value, not zeros after the 17th."""
    high, low = F.floor(size / EXACT), F.pmod(size, F.lit(EXACT)).cast("bigint")
    exact = high.cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    return F.when((size >= WHOLE * 2) & (size < EXACT * EXACT), exact.cast("string")).otherwise(shortest)


def format_number(x: Column, decimals: int = 2, separator: str = ",", zero_sign: bool = False) -> Column:
    """Halves away from zero, thousands separated; a zero has the sign of `x` only if `zero_sign`."""
    x = x.cast("double")
    value = fround(x, decimals)
    text = F.format_number(F.abs(value), decimals)
    shortest, part = F.replace(F.split_part(text, F.lit("."), F.lit(1)), F.lit(","), F.lit("")), F.split_part(text, F.lit("."), F.lit(2))
    joined = F.concat(_grouped(_digits(F.abs(value), shortest), separator), F.when(F.lit(decimals > 0), F.concat(F.lit("."), part)).otherwise(""))
    # The power -1 of a zero is an infinity of its sign.
    minus = (value < 0) | ((value == 0) & (F.pow(x, F.lit(-1.0)) < 0)) if zero_sign else value < 0
    return F.when(F.isnan(value), "NaN").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).otherwise(F.when(minus, F.concat(F.lit("-"), joined)).otherwise(joined))


def format_percent(x: Column, decimals: int = 1, zero_sign: bool = False) -> Column:
    return F.concat(format_number(x.cast("double") * 100, decimals, ",", zero_sign), F.lit("%"))


def sha256(s: Column) -> Column:
    return F.sha2(s, 256)


def md5(s: Column) -> Column:
    return F.md5(s)
