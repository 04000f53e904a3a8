"""Number helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c: Column | str, digits: int = 4) -> Column:
    """Round half up with a hair of slack, so that two engines whose sums differ in the last bits agree."""
    scale = 10.0**digits
    return F.floor(col(c) * F.lit(scale) + F.lit(0.500001)) / F.lit(scale)


def ratio(n: Column | str, d: Column | str, default: float = 0.0) -> Column:
    """n / d, and `default` where d is zero or null."""
    return F.coalesce(F.try_divide(col(n).cast("double"), col(d).cast("double")), F.lit(float(default)))


def finite(c: Column | str) -> Column:
    """Null, NaN and infinities become 0."""
    c = col(c)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def clip(c: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(lo))), F.lit(float(hi)))


def flag(c: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(c, 1).otherwise(0)
