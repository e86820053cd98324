"""A stable hash: the same number for the same value everywhere, spread evenly from 0 up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: SplitMix64's increment and multipliers; FNV-1a's start and prime.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK = (1 << 64) - 1


def stable_hash(x: Column, kind: str, seed: int = 0) -> Column:
    """Of whole numbers, dates, datetimes, bools, floats and strings; wrapping arithmetic runs on Arrow batches."""
    if kind == "string":
        bits = x
    elif kind in ("double", "float"):
        bits = F.when(F.isnan(x), float("nan")).otherwise(x.cast("double") + 0.0)
    elif kind == "date":
        bits = F.unix_date(x).cast("bigint")
    elif kind.startswith("timestamp"):
        bits = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), x)
    else:
        bits = x.cast("bigint")

    @F.pandas_udf("long")
    def hashed(values: pd.Series) -> pd.Series:
        import numpy as np

        def mix(v):
            v = (v ^ (v >> np.uint64(30))) * np.uint64(MIX_A)
            v = (v ^ (v >> np.uint64(27))) * np.uint64(MIX_B)
            return v ^ (v >> np.uint64(31))

        known = values.notna()
        if kind == "string":
            def fold(text):
                h = FNV_START
                for byte in text.encode():
                    h = ((h ^ byte) * FNV_PRIME) & MASK
                return h

            raw = np.array([fold(t) if k else 0 for t, k in zip(values, known, strict=True)], np.uint64)
        elif kind in ("double", "float"):
            raw = values.fillna(float("nan")).to_numpy(np.float64).view(np.uint64)
        else:
            raw = values.fillna(0).to_numpy(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            salt = mix(np.array([(seed + GOLDEN) & MASK], np.uint64))
            out = (mix(raw ^ salt) >> np.uint64(1)).astype(np.int64)
        return pd.Series(out, dtype="Int64").where(known if kind not in ("double", "float") else pd.Series(True, index=values.index))

    return F.when(x.isNotNull(), hashed(bits))
