"""Scalar functions: each builds a Column expression, so plans stay visible to the optimizer."""

from millrace.functions import convert, dates, durations, hashing, lists, math, null, regex, text

__all__ = ["convert", "dates", "durations", "hashing", "lists", "math", "null", "regex", "text"]
