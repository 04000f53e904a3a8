"""Ordered work per key that survives a hot key.

A plain `Window.partitionBy(keys)` puts each key in one task. That is right while every key is small,
and the functions here use it then. When some key exceeds `limit` rows, the rows are range-partitioned
by (keys, order) instead, so that a hot key spans many blocks of similar size, and what a block needs
from earlier ones travels as a few halo rows or as one carried value per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetlens.session import MAX_ROWS_PER_TASK, durable

BLOCK = "_block"
BLOCK_BYTES = 256 << 20

_hot_seen: dict[tuple, bool] = {}


def has_hot_key(df: DataFrame, keys: Sequence[str], limit: int | None = MAX_ROWS_PER_TASK) -> bool:
    """True when some key has more than `limit` rows. One aggregate over the key columns; the answer is
    remembered per plan and its files, since it only chooses between two exact ways. `limit=None` says that the caller
    has already bounded the rows of a key, 0 that a hot key is known."""
    if not keys or limit == 0:
        return True
    if limit is None:
        return False
    memo = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), hash(tuple(df.inputFiles())), tuple(keys), limit)
    if memo not in _hot_seen:
        _hot_seen[memo] = not (
            df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).isEmpty()
        )
    return _hot_seen[memo]


def settle(df: DataFrame, keys: Sequence[str], how: dict) -> dict:
    """Answer the question once for several steps over the same rows."""
    hot = has_hot_key(df, keys, how.get("limit", MAX_ROWS_PER_TASK))
    return {**how, "limit": 0 if hot else None}


def block_number(df: DataFrame) -> int:
    """Blocks of about BLOCK_BYTES of what `df` reads, by Spark's own size estimate, at least the session's shuffle
    partitions. Inputs of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))


def ordered_blocks(df: DataFrame, keys: Sequence[str], by: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Range-partition and sort by (keys, by); `_block` numbers the partitions in that order. Checkpointed,
    because range bounds come from a sample and must not move between the passes that use them."""
    n = blocks or block_number(df)
    cols = [*keys, *by]
    return durable(
        df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn(BLOCK, F.spark_partition_id())
    )


def _same_keys(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null."""
    cond = None
    renamed = b
    for c in on:
        renamed = renamed.withColumnRenamed(c, f"_r_{c}")
        term = a[c].eqNullSafe(F.col(f"_r_{c}"))
        cond = term if cond is None else cond & term
    return a.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    back: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    limit: int | None = MAX_ROWS_PER_TASK,
    blocks: int | None = None,
) -> DataFrame:
    """Add columns that look back at most `back` rows. `build(df, window)` must use only that window."""
    if not has_hot_key(df, keys, limit):
        return build(df, Window.partitionBy(*keys).orderBy(*by))
    part = [*keys, BLOCK]
    cut = ordered_blocks(df, keys, by, blocks)
    starts = (
        cut.groupBy(*part)
        .agg(F.count("*").alias("_size"))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_size").over(
                    Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
    )
    in_block = Window.partitionBy(*part).orderBy(*by)
    placed = _same_keys(cut.withColumn("_n", F.row_number().over(in_block)), starts, part).withColumn(
        "_pos", F.col("_start") + F.col("_n")
    )
    # Row p (from 1) belongs to the halo of every later block that starts after s rows, s-back < p <= s.
    tails = placed.filter(F.col("_n") > F.col("_size") - back).withColumn("_cell", F.floor(F.col("_pos") / back))
    wanted = (
        starts.filter(F.col("_start") > 0)
        .select(*keys, F.col(BLOCK).alias("_to"), F.col("_start").alias("_s"))
        .withColumn("_cell", F.explode(F.array(F.floor(F.col("_s") / back) - 1, F.floor(F.col("_s") / back))))
    )
    halo = (
        _same_keys(tails, wanted, [*keys, "_cell"])
        .filter((F.col("_pos") <= F.col("_s")) & (F.col("_pos") > F.col("_s") - back))
        .withColumn(BLOCK, F.col("_to"))
        .select(*df.columns, BLOCK, F.lit(True).alias("_halo"))
    )
    rows = placed.select(*df.columns, BLOCK, F.lit(False).alias("_halo")).unionByName(halo)
    return build(rows, in_block).filter(~F.col("_halo")).drop(BLOCK, "_halo")


def running(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    sums: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    limit: int | None = MAX_ROWS_PER_TASK,
    blocks: int | None = None,
) -> DataFrame:
    """Running sums, last non-null values and per-key totals, the current row included.

    With no keys the order is global; the rows still stay spread over all tasks.
    """
    sums, last, totals = sums or {}, last or {}, totals or {}
    if keys and not has_hot_key(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*keys)
        cols = {c: F.sum(v).over(w) for c, v in sums.items()}
        cols |= {c: F.last(v, ignorenulls=True).over(w) for c, v in last.items()}
        cols |= {c: F.sum(v).over(whole) for c, v in totals.items()}
        return df.withColumns(cols)
    inputs = {f"_v_{c}": v for c, v in {**sums, **last, **totals}.items()}
    cut = ordered_blocks(df.withColumns(inputs), keys, by, blocks)
    part = [*keys, BLOCK]
    order = F.struct(*by)
    per_block = cut.groupBy(*part).agg(
        *[F.sum(f"_v_{c}").alias(f"_b_{c}") for c in {**sums, **totals}],
        *[
            F.max_by(F.col(f"_v_{c}"), F.when(F.col(f"_v_{c}").isNotNull(), order)).alias(f"_b_{c}")
            for c in last
        ],
        F.count("*").alias("_b_rows"),
    )
    # One row per (key, block): at most blocks + keys rows.
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    carry = per_block.select(
        *part,
        *[F.sum(f"_b_{c}").over(before).alias(f"_c_{c}") for c in sums],
        *[F.last(f"_b_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in last],
        *[F.sum(f"_b_{c}").over(every).alias(f"_c_{c}") for c in totals],
    )
    w = Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns(
        {f"_l_{c}": F.sum(f"_v_{c}").over(w) for c in sums}
        | {f"_l_{c}": F.last(f"_v_{c}", ignorenulls=True).over(w) for c in last}
    )
    out = _same_keys(local, carry, part)
    return out.select(
        *df.columns,
        *[
            F.when(F.col(f"_c_{c}").isNull(), F.col(f"_l_{c}"))
            .otherwise(F.coalesce(F.col(f"_l_{c}"), F.lit(0)) + F.col(f"_c_{c}"))
            .alias(c)
            for c in sums
        ],
        *[F.coalesce(F.col(f"_l_{c}"), F.col(f"_c_{c}")).alias(c) for c in last],
        *[F.col(f"_c_{c}").alias(c) for c in totals],
    )


def last_n(df: DataFrame, keys: Sequence[str], by: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows of each key in the given order. Spark cuts each map task to `n` rows per key
    before the shuffle, so a hot key sends only n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
