"""Small numeric helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """Name -> column, number/bool/None -> literal, column -> itself."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def rnd(value, digits: int) -> Column:
    """Round half up in plain double arithmetic, so any IEEE engine gives the same bits."""
    scale = float(10**digits)
    return F.floor(as_col(value) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp(value, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (``greatest``/``least`` alone would drop it)."""
    c = as_col(value)
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def ratio(numerator, denominator, default=0.0) -> Column:
    """numerator / denominator, ``default`` when the denominator is zero."""
    n, d = as_col(numerator), as_col(denominator)
    return F.when(d != 0, n.cast("double") / d.cast("double")).otherwise(F.lit(default).cast("double"))


def finite_or_zero(value) -> Column:
    """PRJ-14: NaN and both infinities become 0; NULL becomes 0 too."""
    c = as_col(value).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def let(value, body) -> Column:
    """``body(value)`` with the value computed once, also when the body uses it inside another lambda."""
    return F.get(F.transform(F.array(as_col(value)), lambda v: body(v)), F.lit(0))
