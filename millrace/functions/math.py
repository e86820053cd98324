"""Numbers. Floats follow IEEE: division by zero and logarithms outside their domain are not errors or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
#: From here on a double has no digits after the point.
WHOLE = float(1 << 52)


def fdiv(a: Column, b: Column) -> Column:
    """Float division: x / 0 is infinite, by the signs of both, 0 / 0 is NaN."""
    x, y = a.cast("double"), b.cast("double")
    # The power -1 of a zero is an infinity of its sign.
    return F.when(y != 0, x / y).when(y == 0, x * F.pow(y, F.lit(-1.0)))


def div(a: Column, b: Column) -> Column:
    """Whole division toward zero; a zero divisor is an error."""
    return F.call_function("div", a, b)


def abs_(x: Column) -> Column:
    return F.abs(x)


def fround(x: Column, digits: int = 0) -> Column:
    """Rounds a float by its binary value, halves away from zero."""
    scale = 10.0**digits
    y = F.abs(x * F.lit(scale))
    low = F.floor(y).cast("double")
    rounded = F.signum(x) * (low + F.when(y - low >= 0.5, 1.0).otherwise(0.0)) / F.lit(scale)
    return F.when(F.isnan(x) | (y == INF), x).when(y >= WHOLE, x * F.lit(scale) / F.lit(scale)).otherwise(rounded + 0.0)


def round_(x: Column, digits: int = 0, decimal: bool = False) -> Column:
    """Rounds halves away from zero; of a decimal (pass decimal=True), exactly."""
    return F.round(x, digits).cast("decimal(38,6)") if decimal else fround(x.cast("double"), digits)


def trunc(x: Column, digits: int = 0) -> Column:
    """Cuts digits without rounding."""
    scale = 10.0**digits
    y = x.cast("double") * F.lit(scale)
    cut = F.when(F.abs(y) >= WHOLE, y).when(y < 0, F.ceil(y).cast("double")).otherwise(F.floor(y).cast("double"))
    return F.when(F.isnan(y), y).otherwise(cut / F.lit(scale))


def floor(x: Column) -> Column:
    return F.when(F.isnan(x.cast("double")) | (F.abs(x) >= WHOLE), x.cast("double")).otherwise(F.floor(x).cast("double"))


def ceil(x: Column) -> Column:
    return F.when(F.isnan(x.cast("double")) | (F.abs(x) >= WHOLE), x.cast("double")).otherwise(F.ceil(x).cast("double") + 0.0)


def sqrt(x: Column) -> Column:
    return F.sqrt(x)


def pow_(x: Column, y) -> Column:
    return F.pow(x.cast("double"), y if isinstance(y, Column) else F.lit(float(y)))


def exp(x: Column) -> Column:
    return F.exp(x)


def _log(x: Column, of) -> Column:
    y = x.cast("double")
    return F.when(y == 0, F.lit(-INF)).when(y < 0, F.lit(NAN)).otherwise(of(y))


def ln(x: Column) -> Column:
    """-inf at zero, NaN below."""
    return _log(x, F.ln)


def log10(x: Column) -> Column:
    return _log(x, F.log10)


def log2(x: Column) -> Column:
    return _log(x, F.log2)


def log(x: Column, base: float) -> Column:
    return _log(x, lambda y: F.ln(y) / F.ln(F.lit(float(base))))


def sign(x: Column, kind: str = "double") -> Column:
    """-1, 0 or 1, as `kind`."""
    return F.signum(x).cast(kind)


def is_nan(x: Column) -> Column:
    return F.when(x.isNotNull(), F.isnan(x.cast("double")))


def is_finite(x: Column) -> Column:
    y = x.cast("double")
    return F.when(x.isNotNull(), ~F.isnan(y) & (F.abs(y) != INF))


sin, cos, tan, asin, acos, atan, degrees, radians = F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.degrees, F.radians


def atan2(y: Column, x: Column) -> Column:
    return F.atan2(y, x)


def pi() -> Column:
    return F.pi()
