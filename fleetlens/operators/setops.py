"""Unions, column alignment, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_labelled(parts: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """All rows of the given sets with the set's name, in time order; missing columns become null."""
    named = [df.withColumn(label, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).orderBy("timestamp")


def align_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exactly `cols`, in order; those the frame lacks are 0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in cols])


def upsert(current: DataFrame, updates: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The current rows with the latest update per key in their place, new keys added. `order` columns rank
    the updates of one key; a current row ranks below every update."""
    value = [c for c in current.columns if c != key]
    rank = F.struct(F.lit(1).alias("_new"), *[F.col(c) for c in order])
    newest = updates.groupBy(key).agg(F.max_by(F.struct(*value), rank).alias("_u"))
    old = current.select(key, F.struct(*value).alias("_o"))
    merged = old.join(newest, key, "full_outer")
    return merged.select(key, F.coalesce("_u", "_o").alias("_v")).select(key, "_v.*")


def insert_missing(current: DataFrame, new: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Current rows, and of each key they lack the first new row."""
    value = [c for c in new.columns if c != key]
    first = new.join(current.select(key), key, "left_anti")
    rank = F.struct(*order) if order else F.struct(*value)
    first = first.groupBy(key).agg(F.min_by(F.struct(*value), rank).alias("_v")).select(key, "_v.*")
    return current.unionByName(first, allowMissingColumns=True)


def first_present(*cols: Column) -> Column:
    return F.coalesce(*cols)
