"""Exact quantiles per group from value counts: no group is gathered into one buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.ordered import running
from fleetlens.session import MAX_ROWS_PER_TASK


def value_ranks(
    counts: DataFrame, keys: Sequence[str], value: str, n: str, limit: int | None = MAX_ROWS_PER_TASK, blocks: int | None = None
) -> DataFrame:
    """Adds `_upto` (rows with a value <= this one) and `_all` (rows of the key) to a table of value counts."""
    return running(
        counts, keys, [value], sums={"_upto": F.col(n)}, totals={"_all": F.col(n)}, limit=limit, blocks=blocks
    )


def _at(rank: Column, value: str, n: str) -> Column:
    held = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col(n))
    return F.max(F.when(held, F.col(value)))


def linear(value: str, n: str, p: float) -> Column:
    """Aggregate over `value_ranks` rows: the linearly interpolated quantile."""
    h = (F.max("_all") - 1) * F.lit(p)
    row_h = (F.col("_all") - 1) * F.lit(p)
    low, high = _at(F.floor(row_h), value, n), _at(F.ceil(row_h), value, n)
    return low + (high - low) * (h - F.floor(h))


def by_index(value: str, n: str, p: float) -> Column:
    """Aggregate over `value_ranks` rows: the element at index int(rows * p) of the sorted values."""
    row_i = F.least(F.floor(F.col("_all") * F.lit(p)), F.col("_all") - 1)
    return _at(row_i, value, n)


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    probs: dict[str, float],
    method: str = "linear",
    limit: int | None = MAX_ROWS_PER_TASK,
    blocks: int | None = None,
) -> DataFrame:
    """One row per key, one column per entry of `probs`; nulls in `col` do not count."""
    pick = {"linear": linear, "index": by_index}[method]
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    ranked = value_ranks(counts, keys, col, "_n", limit, blocks)
    return ranked.groupBy(*keys).agg(*[pick(col, "_n", p).alias(name) for name, p in probs.items()])
