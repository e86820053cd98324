"""Regular expressions. Patterns are program values; those that need look-around or back references are refused."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_pattern(pattern: str) -> str:
    """The pattern as Java reads it."""
    if re.search(r"\(\?(=|!|<=|<!)|(?<!\\)\\[1-9]", pattern):
        raise ValueError("look-around and back references are not supported")
    return pattern.replace("(?P<", "(?<")


def java_replacement(text: str) -> str:
    """`$1`, `${1}`, `$name`, `${name}` and `$$` as Java reads them."""

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return "\\$"
        name = m[1] or m[2]
        return f"${name}" if name.isdigit() else f"${{{name}}}"

    return re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)", one, text.replace("\\", "\\\\"))


def regex_match(s: Column, pattern: str) -> Column:
    return s.rlike(java_pattern(pattern))


def regex_extract(s: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null if there is none or the group has no part in it."""
    p = java_pattern(pattern)
    found = F.regexp_extract_all(s, F.lit(p), F.lit(group))
    return F.when(s.rlike(p), F.nullif(F.get(found, F.lit(0)), F.lit("")) if group else F.get(found, F.lit(0)))


def regex_replace(s: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(s, java_pattern(pattern), java_replacement(to))


def regex_count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(java_pattern(pattern))).cast("bigint")
