"""Stored tables that change by partition: repeated batches, deletions and merges touch only what they must.

A table is a folder of Parquet files under partition folders. New content of a partition is staged by Spark and moved into
place when its job commits (dynamic partition overwrite); other partitions keep their files. What reaches
the driver is a row per touched partition, never a row of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import durable

BATCH = "batch"
_FOLDER, _GONE = "_folder", "_gone"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark knows."""
    p = _path(spark, path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_found(spark: SparkSession, folders: Sequence[str]) -> None:
    """Delete folders named as in `_metadata.file_path`, a URI."""
    for name in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def replace_partitions(df: DataFrame, path: str, parts: Sequence[str]) -> None:
    """Write `df` in place of the partitions it has rows of. Large partitions are split and small ones merged at run time."""
    df.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _folder() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", "")


def _same(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    """Equality of columns that may be null."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def read_table(spark: SparkSession, path: str, keep_batch: bool = False) -> DataFrame:
    """The rows of a table, without the names of their batches."""
    df = spark.read.option("basePath", path).parquet(path)
    return df if keep_batch or BATCH not in df.columns else df.drop(BATCH)


def append_batch(df: DataFrame, path: str, parts: Sequence[str], batch: str) -> None:
    """Add the rows of a named batch. A batch of that name that is already there, whole or from a failed attempt, is
    replaced, so that a repeated batch adds nothing.

    The name is the last partition column. A partition that the batch had and now lacks is removed."""
    spark, name = df.sparkSession, f"b_{batch}"  # never read as a number or a date

    def files() -> dict[str, str]:
        if not exists(spark, path):
            return {}
        mine = read_table(spark, path, keep_batch=True).where(F.col(BATCH) == name)
        return dict(mine.select(F.col("_metadata.file_path"), _folder()).distinct().collect())

    before = files()
    replace_partitions(df.withColumn(BATCH, F.lit(name)), path, [*parts, BATCH])
    if before:
        _remove_found(spark, sorted({folder for file, folder in files().items() if file in before}))


def delete_rows(spark: SparkSession, path: str, parts: Sequence[str], gone: Column | None = None, within: Column | None = None, keys: DataFrame | None = None) -> int:
    """Delete the rows for which `gone` holds, or whose key is among `keys`; the number of deleted rows.

    A partition without such rows keeps its files, one that has only such rows is dropped, and any other is written
    anew. `within`, a condition on partition columns, says where such rows can be; no other partition is
    read. The rows that stay are made durable before anything is replaced, so a failed attempt can be repeated."""
    table = read_table(spark, path, keep_batch=True)
    parts = [*parts, *([BATCH] if BATCH in table.columns else [])]
    at = table.select("*", _folder().alias(_FOLDER))
    at = at if within is None else at.where(within)
    if keys is not None:
        hit = keys.distinct().withColumn(_GONE, F.lit(True))
        at = at.join(hit, _same(at, hit, keys.columns), "left").select(*[at[c] for c in at.columns], F.coalesce(_GONE, F.lit(False)).alias(_GONE))
    else:
        at = at.withColumn(_GONE, F.coalesce(gone, F.lit(False)))
    counts = at.groupBy(_FOLDER).agg(F.count("*").alias("n"), F.count_if(F.col(_GONE)).alias("g")).where("g > 0").collect()
    partly = [r[_FOLDER] for r in counts if r["g"] < r["n"]]
    if partly:
        touched = spark.createDataFrame([(x,) for x in partly], f"{_FOLDER} string")
        replace_partitions(durable(at.where(~F.col(_GONE)).join(touched, _FOLDER, "left_semi").select(*table.columns)), path, parts)
    _remove_found(spark, [r[_FOLDER] for r in counts if r["g"] == r["n"]])
    return sum(r["g"] for r in counts)


def merge_rows(spark: SparkSession, path: str, updates: DataFrame, key: str, parts: Sequence[str], order: Sequence[str] = (), overwrite: bool = True) -> dict[str, int]:
    """Put the latest update of each key in the place of its row and add new keys; how many rows were added and changed.

    `order` ranks the updates of one key. Without `overwrite` rows that are there stay, and of a new key the first
    update counts. Only partitions that lose, gain or change a row are written, so a repeated merge writes nothing.
    A row may move to another partition. Partitions are replaced one by one; a merge that failed half-way is
    completed by repeating it."""
    table = read_table(spark, path)
    value = [c for c in table.columns if c != key]
    rank = F.struct(*[F.col(c) for c in order or value])
    pick = F.max_by if overwrite else F.min_by
    newest = updates.groupBy(F.col(key).alias("_key")).agg(pick(F.struct(*value), rank).alias("_new"))
    old = table.select(key, F.struct(*value).alias("_old"))
    met = old.join(newest, old[key].eqNullSafe(newest["_key"]), "full_outer")
    added = F.col("_old").isNull()
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old")) if overwrite else F.lit(False)
    news = durable(met.where(added | changed).select(F.coalesce(key, "_key").alias(key), "_new", "_old", added.alias("_added")))
    told = news.agg(F.count_if("_added").alias("added"), F.count_if(~F.col("_added")).alias("changed")).first()
    if not told["added"] + told["changed"]:
        return {"added": 0, "changed": 0}
    # Partitions that a row leaves or enters.
    entered, left = (news.where(F.col(s).isNotNull()).select(*[F.col(f"{s}.{c}").alias(c) for c in parts]) for s in ("_new", "_old"))
    dirty = durable(entered.unionByName(left).distinct())
    same = table.join(dirty, _same(table, dirty, parts), "left_semi")
    moved = news.where(~F.col("_added")).select(F.col(key).alias("_key"))
    same = same.join(moved, same[key].eqNullSafe(moved["_key"]), "left_anti")
    after = durable(same.unionByName(news.select(key, "_new.*").select(*table.columns)))
    filled = after.select(*parts).distinct()
    emptied = dirty.join(filled, _same(dirty, filled, parts), "left_anti")
    folders = table.select(*parts, _folder().alias(_FOLDER)).join(emptied, _same(table, emptied, parts), "left_semi").select(_FOLDER).distinct().collect()
    replace_partitions(after, path, parts)
    _remove_found(spark, [r[_FOLDER] for r in folders])
    return {"added": told["added"], "changed": told["changed"]}
