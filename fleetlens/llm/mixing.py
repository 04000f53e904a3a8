"""Mixing sources to target weights by systematic sampling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD
from fleetlens.session import durable

#: Documents of one source that one window orders; a larger source is split into blocks by a digest of the id.
BLOCK_ROWS = 16384
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(value: Column, digits: int) -> Column:
    """The first hexadecimal digits of an MD5 sum as a number."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, documents, target) of (source, size) rows.

    Sources by code point, null last, get the weights in turn and share `share` of all sizes. A target stops
    at `most` times its source's size; the excess goes to the others by weight until none is above. The one
    window without a key orders sources, one row each. A source without words has target 0."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    w = F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    full = sources.withColumn("full", left * F.col("weight") >= F.col("most") * F.sum("weight").over(onward))
    rest = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("most")).otherwise(rest * F.col("weight") / open_weight)
    return full.select("source", "source_size", "documents", target.alias("target"))


def mix(docs: DataFrame, size: Column, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: tuple = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every document, with source, size, source_size, target, copies and taken.

    Every document of a source expects target / source_size copies. The expectations are summed up along the
    source, from one random offset of the source, and a document is taken once for each integer that the sum
    passes in it. Documents lie in order of size inside a block, so a sample's size keeps close to its target.
    A block is a share of a source by a digest of doc_id, so a large source is summed by many tasks.

    Null source: a source of its own, last. Null text: size 0, copies as any other. Repeated rows count as
    documents of their own. Needs columns doc_id and source; other columns are ignored unless in `keep`."""
    if "doc_id" not in keep:
        keep = ("doc_id", *keep)
    sizes = durable(docs.select(*keep, F.col("source").cast("string").alias("source"), size.alias("size")))
    plan = targets(sizes, weights, share, most)
    same = lambda a, b: a.eqNullSafe(b)
    wide = sizes.join(plan.withColumnRenamed("source", "of"), same(F.col("source"), F.col("of"))).drop("of")
    blocks = F.ceil(F.col("documents") / F.lit(BLOCK_ROWS))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    wide = wide.withColumn("block", _digest(name, 8) % blocks)
    inside = Window.partitionBy("source", "block").orderBy("size", "doc_id")
    wide = wide.withColumn("place", F.row_number().over(inside))
    counts = wide.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(F.col("source").alias("of"), F.col("block").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    wide = wide.join(ahead, same(F.col("source"), F.col("of")) & (F.col("block") == F.col("at")), "left")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _digest(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))), 4) / F.lit(65536.0)
    place = F.col("ahead") + F.col("place")
    crossed = F.floor(each * place + offset) - F.floor(each * (place - 1) + offset)
    copies = F.least(crossed, F.lit(int(most))).cast("int")
    wide = wide.withColumn("copies", copies)
    return wide.select(*keep, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of `mix` as often as it is taken."""
    return mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
