"""Retention of histories, incidents and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.dates import before, moment
from fleetlens.operators.joins import cascade_delete
from fleetlens.sources.partitions import delete_rows, read_table


def retain(df: DataFrame, ts: str, as_of, hours: float) -> DataFrame:
    """Rows no older than `hours`."""
    return df.filter(F.col(ts) >= before(as_of, hours=hours))


def retain_metrics(df: DataFrame, as_of, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row with the number deleted)."""
    cutoff = before(as_of, days=days)
    gone = df.agg(F.count_if(F.col("timestamp") < cutoff).alias("deleted"))
    return df.filter(F.col("timestamp") >= cutoff), gone


def retain_incidents(inc: DataFrame, act: DataFrame, as_of, days: int = 180) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incidents, actions, counts): old incidents go with all their actions, then old actions on their own.

    The action count covers only those the cascade left."""
    cutoff = before(as_of, days=days)
    old = inc.filter(F.col("timestamp") < cutoff)
    left, _ = cascade_delete(act, old)
    counts = old.agg(F.count("*").alias("n")).withColumn("kind", F.lit("incidents")).unionByName(
        left.agg(F.count_if(F.col("timestamp") < cutoff).alias("n")).withColumn("kind", F.lit("remediation_actions"))
    )
    return inc.filter(F.col("timestamp") >= cutoff), left.filter(F.col("timestamp") >= cutoff), counts.select("kind", "n")


def stamp(df: DataFrame, as_of) -> DataFrame:
    return df.withColumn("updated_at", moment(as_of))


def expire_days(spark, path: str, as_of, days: float, ts: str = "timestamp", keys: Sequence[str] = ()) -> int:
    """Delete from a table with a `date` folder per day what is older than `days`; the number of deleted rows. Whole days go as
    folders and only the day of the cutoff is written anew; later days are not read."""
    cutoff = before(as_of, days=days)
    return delete_rows(spark, path, [*keys, "date"], F.col(ts) < cutoff, F.col("date") <= F.to_date(cutoff))


def month(ts: str) -> Column:
    """Number of a month, for tables with a `month` folder."""
    return F.year(ts) * 100 + F.month(ts)


def expire_incidents(spark, inc_path: str, act_path: str, as_of, days: float = 180) -> dict[str, int]:
    """`retain_incidents` on stored tables with a `month` folder; the number of deleted rows of each table.

    Incidents go last, so that a repeated attempt finds the same ones. The action count covers only those the cascade
    left; all that the cascade took is counted as `cascaded`."""
    cutoff = before(as_of, days=days)
    old, early = F.col("timestamp") < cutoff, F.col("month") <= F.year(cutoff) * 100 + F.month(cutoff)
    doomed = read_table(spark, inc_path).where(early & old).select(F.col("id").alias("incident_id"))
    cascaded = delete_rows(spark, act_path, ["month"], keys=doomed)
    actions = delete_rows(spark, act_path, ["month"], old, early)
    return {"cascaded": cascaded, "remediation_actions": actions, "incidents": delete_rows(spark, inc_path, ["month"], old, early)}
