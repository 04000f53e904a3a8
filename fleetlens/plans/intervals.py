"""Time-interval matching without nested loops and without listing pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.ordered import has_hot_key, running
from fleetlens.session import MAX_ROWS_PER_TASK


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp, with or without zone (UTC session)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def exists_between(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    lo: Column,
    hi: Column,
    right_ts: str,
    width_us: int,
    name: str,
) -> DataFrame:
    """Flag each left row that has a right row of the same key in [lo, hi], both ends included.

    `hi - lo` must equal `width_us`. Time is cut into cells of that width: the interval then touches the
    cell of `lo` and the one after it, and the answer follows from the latest right row of the first and
    the earliest of the second. The right side shrinks to one row per (key, cell) before it is joined, so
    no left row multiplies and a hot key or cell brings no pairs.
    """
    cell = F.floor(F.col("_t") / width_us)
    ends = (
        right.select(*keys, micros(right_ts).alias("_t"))
        .groupBy(*keys, cell.alias("_c"))
        .agg(F.min("_t").alias("_min"), F.max("_t").alias("_max"))
    )
    # Cell c is asked for as "the cell of lo" (c) and as "the one after" (c - 1); one row per asking cell.
    none = F.lit(None).cast("long")
    uses = F.array(
        F.struct(F.col("_c").alias("_cell"), F.col("_max").alias("_last"), none.alias("_first")),
        F.struct((F.col("_c") - 1).alias("_cell"), none.alias("_last"), F.col("_min").alias("_first")),
    )
    asked = (
        ends.select(*keys, F.inline(uses))
        .groupBy(*keys, "_cell")
        .agg(F.max("_last").alias("_last"), F.min("_first").alias("_first"))
    )
    rows = left.withColumns({"_lo": micros(lo), "_hi": micros(hi)}).withColumn(
        "_cell", F.floor(F.col("_lo") / width_us)
    )
    hit = F.coalesce(F.col("_last") >= F.col("_lo"), F.lit(False)) | F.coalesce(
        F.col("_first") <= F.col("_hi"), F.lit(False)
    )
    return rows.join(asked, [*keys, "_cell"], "left").select(*[rows[c] for c in left.columns], hit.alias(name))


def sum_between(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    row_id: Sequence[str],
    lo: Column,
    hi: Column,
    right_ts: str,
    values: dict[str, Column],
    include_lo: bool = True,
    limit: int | None = MAX_ROWS_PER_TASK,
    blocks: int | None = None,
) -> DataFrame:
    """Add to each left row the sums of right values with a time in [lo, hi] or (lo, hi].

    Both ends of every interval are placed among the right rows and read the running sum there; the
    difference of the two reads is the answer. `row_id` columns must name a left row uniquely.
    """
    first = 0 if include_lo else 2
    zero = {c: F.lit(0) for c in values}
    ends = left.withColumn(
        "_end",
        F.explode(
            F.array(
                F.struct(micros(lo).alias("t"), F.lit(first).alias("o")),
                F.struct(micros(hi).alias("t"), F.lit(3).alias("o")),
            )
        ),
    )
    marks = ends.select(
        *left.columns, F.col("_end.t").alias("_t"), F.col("_end.o").alias("_o"), *[v.alias(f"_x_{c}") for c, v in zero.items()]
    )
    facts = right.select(
        *keys, micros(right_ts).alias("_t"), F.lit(1).alias("_o"), *[v.alias(f"_x_{c}") for c, v in values.items()]
    )
    line = marks.unionByName(facts, allowMissingColumns=True)
    summed = running(
        line, keys, ["_t", "_o"], sums={f"_s_{c}": F.col(f"_x_{c}") for c in values}, limit=limit, blocks=blocks
    ).filter(F.col("_o") != 1)
    rest = [c for c in left.columns if c not in row_id]
    diff = {
        c: F.sum(F.when(F.col("_o") == 3, F.col(f"_s_{c}")).otherwise(-F.col(f"_s_{c}"))).alias(c) for c in values
    }
    return (
        summed.groupBy(*row_id)
        .agg(*[F.first(c).alias(c) for c in rest], *diff.values())
        .select(*left.columns, *values)
    )


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    lo: Column,
    hi: Column,
    right_ts: str,
    width_us: int,
    how: str = "inner",
) -> DataFrame:
    """Rows of both sides with equal keys and `right_ts` in [lo, hi]; `hi - lo <= width_us`.

    Each left row asks at most two cells of that width, each right row has exactly one, so no pair comes
    twice. Right columns that share a name with a left one get the prefix `r_`. Adaptive execution splits
    hot cells.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}" if c in left.columns and c not in keys else c) for c in right.columns])
    rts = f"r_{right_ts}" if right_ts in left.columns else right_ts
    r = r.withColumn("_t", micros(rts)).withColumn("_cell", F.floor(F.col("_t") / width_us))
    l = left.withColumns({"_lo": micros(lo), "_hi": micros(hi)})
    asked = l.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_lo") / width_us), F.floor(F.col("_hi") / width_us)))
    )
    pairs = asked.join(r, [*keys, "_cell"]).filter(F.col("_t").between(F.col("_lo"), F.col("_hi")))
    out = [*left.columns, *[c for c in r.columns if c not in (*keys, "_t", "_cell")]]
    if how == "inner":
        return pairs.select(*out)
    raise ValueError(f"unsupported join type {how!r}; use exists_between for left matches")


def trailing_sum(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    row_id: Sequence[str],
    seconds: float,
    values: dict[str, Column],
    include_lo: bool = True,
    limit: int | None = MAX_ROWS_PER_TASK,
    blocks: int | None = None,
) -> DataFrame:
    """Per row the sums of its key's values in [t - seconds, t], or (t - seconds, t]; rows of equal time
    count each other. A hot key goes through `sum_between`, which needs `row_id` to be unique."""
    us = int(seconds * 1_000_000)
    if not has_hot_key(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(-us if include_lo else 1 - us, 0)
        return df.withColumns({c: F.sum(v).over(w) for c, v in values.items()})
    t = F.col(ts)
    right = df.withColumns({f"_w_{c}": v for c, v in values.items()})
    return sum_between(
        df, right, keys, row_id, t - F.make_dt_interval(secs=F.lit(float(seconds))), t, ts,
        {c: F.col(f"_w_{c}") for c in values}, include_lo, limit, blocks,
    )
