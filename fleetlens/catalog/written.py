"""Queries that write a table with a sink and read it back (inventory groups A, K24 and M)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from fleetlens.catalog.base import SQL, query
from fleetlens.functions.numeric import fixed
from fleetlens.operators import forecast
from fleetlens.operators import retention as ret
from fleetlens.session import checkpoint_dir
from fleetlens.sources import ingest
from fleetlens.sources import partitions as parts
from fleetlens.sources import tables as t


def _home(spark) -> str:
    """A new folder beside the checkpoints, which every executor reaches."""
    return f"{checkpoint_dir(spark)}/out-{uuid4().hex}"


@query("a1_append_metrics", "select service_name, cast(timestamp as date)::varchar as day, sum(request_count)::bigint as requests, count(*) as n from metrics_wide group by 1, 2")
def a1(spark, p):
    home = _home(spark)
    ingest.append_metrics(t.metrics_wide(spark, p), home, "first")
    back = parts.read_table(spark, home)
    return back.groupBy("service_name", F.col("date").cast("string").alias("day")).agg(F.sum("request_count").alias("requests"), F.count("*").alias("n"))


@query("a2_export_csv", "select service_name, cast(timestamp as varchar) as timestamp, error_rate from metrics_wide where timestamp between timestamp '2024-01-05' and timestamp '2024-01-12'")
def a2_csv(spark, p):
    home = _home(spark)
    ingest.export_metrics(t.metrics_wide(spark, p), "csv", home, "2024-01-05 00:00:00", "2024-01-12 00:00:00")
    back = spark.read.option("header", True).csv(home)
    when = F.date_format(F.col("timestamp").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    return back.select("service_name", when.alias("timestamp"), F.col("error_rate").cast("double").alias("error_rate"))


@query("a3_save_training", "select service_name, case when error_rate > 0.4 then 'error_storm_active' else 'normal' end as label, count(*) as n from metrics_wide group by 1, 2")
def a3(spark, p):
    home = _home(spark)
    m = t.metrics_wide(spark, p).withColumn("label", F.when(F.col("error_rate") > 0.4, "error_storm_active").otherwise("normal"))
    ingest.save_training(m, f"{home}/csv", f"{home}/history", "first")
    return spark.read.option("header", True).csv(f"{home}/csv").groupBy("service_name", "label").agg(F.count("*").alias("n"))


@query("a12_append_predictions", "select risk_level, count(*) as n, min(timestamp) as first_at from predictions group by 1")
def a12(spark, p):
    """Two batches, the second of them twice."""
    home, rows = _home(spark), t.predictions(spark, p)
    odd = F.col("id") % 2 == 1
    for part, batch in ((~odd, "even"), (odd, "odd"), (odd, "odd")):
        ingest.append_predictions("failures", rows.where(part), home, batch)
    back = parts.read_table(spark, f"{home}/failures")
    return back.groupBy("risk_level").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_at"))


@query("a7_stored_incidents", """select md5('{"id":' || id || ',"type":"' || type || '","service_name":"' || service_name || '"}') as id, service_name as affected_service, type, 'INFO' as severity, 'ACTIVE' as status, timestamp,
  concat('{"value":', case when value > 50 then 'true' else 'false' end, '}') as details from incident_events""")
def a7_stored(spark, p):
    """Detections written to the incident log, a retry included, and read back with their ids."""
    home = _home(spark)
    d = t.incident_events(spark, p).select("service_name", "type", F.lit("INFO").alias("severity"), "timestamp", "id", F.struct((F.col("value") > 50).alias("value")).alias("details"))
    for _ in range(2):
        ingest.log_incidents(d, home, ["id"], "poll-1")
    return parts.read_table(spark, home).select("id", "affected_service", "type", "severity", "status", "timestamp", "details")


# Folders of the configuration table.
_FOLDERS = 8


def _config(df):
    """Configuration rows with the folder of their key, which does not change with its row."""
    return df.withColumn("folder", F.pmod(F.xxhash64("key"), F.lit(_FOLDERS)).cast("int"))


@query("a9_stored_upsert")
def a9_stored(spark, p):
    """Configuration updates merged into the stored table, then once more."""
    home, columns = _home(spark), t.config_rows(spark, p).columns
    parts.replace_partitions(_config(t.config_rows(spark, p)), home, ["folder"])
    new = _config(t.config_updates(spark, p).withColumn("updated_by", F.lit("api")))
    for _ in range(2):
        parts.merge_rows(spark, home, new, "key", ["folder"], ["updated_at", "seq"])
    return parts.read_table(spark, home).select(*columns)


@query("a10_stored_insert")
def a10_stored(spark, p):
    """New keys added to the stored table, rows that are there kept."""
    home, columns = _home(spark), t.config_rows(spark, p).columns
    parts.replace_partitions(_config(t.config_rows(spark, p)), home, ["folder"])
    new = _config(t.config_updates(spark, p).withColumn("updated_by", F.lit("seed")))
    for _ in range(2):
        parts.merge_rows(spark, home, new, "key", ["folder"], ["updated_at", "seq"], overwrite=False)
    return parts.read_table(spark, home).select(*columns)


@query("a8_stored_resolve")
def a8_stored(spark, p):
    """Incidents with a successful action closed in the stored table; months without one keep their files."""
    home = _home(spark)
    inc = t.incidents(spark, p).withColumns({"resolved_at": F.lit(None).cast("timestamp_ntz"), "month": ret.month("timestamp")})
    parts.replace_partitions(inc, home, ["month"])
    for _ in range(2):
        stored = parts.read_table(spark, home)
        closed = ingest.resolve_incidents(stored, t.remediation_actions(spark, p)).where("status = 'RESOLVED' and resolved_at is not null")
        parts.merge_rows(spark, home, closed, "id", ["month"])
    return parts.read_table(spark, home).select("id", "status", "resolved_at", "resolution_time_seconds")


@query("k24_stored_forecaster", None)
def k24(spark, p):
    home = _home(spark)
    forecast.save_forecaster(forecast.fit_forecaster(t.metrics_long(spark, p)), home)
    fc = forecast.forecast(forecast.load_forecaster(spark, home), "2024-01-31 00:00:00", 3)
    return fc.withColumns({c: fixed(c) for c in ("forecast", "lower_bound", "upper_bound")})


@query("m1_expire_metrics", """select service_name, count(*) filter (timestamp >= timestamp '2024-01-31' - interval 245 hour) as kept, (select count(*) from metrics_wide where timestamp < timestamp '2024-01-31' - interval 245 hour) as deleted
from metrics_wide where timestamp >= timestamp '2024-01-31' - interval 245 hour group by 1""")
def m1_expire(spark, p):
    """Old metrics deleted in place, twice; the second time nothing is left to delete."""
    home = _home(spark)
    ingest.append_metrics(t.metrics_wide(spark, p), home, "first")
    n = sum(ret.expire_days(spark, home, "2024-01-31 00:00:00", 245 / 24, keys=["service_name"]) for _ in range(2))
    return parts.read_table(spark, home).groupBy("service_name").agg(F.count("*").alias("kept"), F.lit(n).cast("long").alias("deleted"))


@query("m2_expire_days", "select id, timestamp from incident_events where timestamp >= timestamp '2024-01-31' - interval 10 day")
def m2_days(spark, p):
    home = _home(spark)
    ingest.append_by_day(t.incident_events(spark, p), home, "first")
    ret.expire_days(spark, home, "2024-01-31 00:00:00", 10)
    return parts.read_table(spark, home).select("id", "timestamp")


@query("m3_expire_incidents", """with cut as (select timestamp '2001-08-01' - interval 180 day as c), old as (select id from incidents, cut where timestamp < c),
 act as (select a.*, incident_id in (select id from old) as cascaded, timestamp < c as late from remediation_actions a, cut)
select a.id, a.incident_id, n.* from act a, (select count(*) filter (cascaded) as cascaded, count(*) filter (late and not cascaded) as actions, (select count(*) from old) as incidents from act) n where not a.cascaded and not late""")
def m3_expire(spark, p):
    """Old incidents deleted from the stored tables with their actions, then old actions; what stays, with the counts."""
    home = _home(spark)
    parts.replace_partitions(t.incidents(spark, p).withColumn("month", ret.month("timestamp")), f"{home}/incidents", ["month"])
    parts.replace_partitions(t.remediation_actions(spark, p).withColumn("month", ret.month("timestamp")), f"{home}/actions", ["month"])
    n = ret.expire_incidents(spark, f"{home}/incidents", f"{home}/actions", "2001-08-01 00:00:00")
    left = parts.read_table(spark, f"{home}/actions").select("id", "incident_id")
    counts = {"cascaded": n["cascaded"], "actions": n["remediation_actions"], "incidents": n["incidents"]}
    return left.withColumns({k: F.lit(v).cast("long") for k, v in counts.items()})


def _twins() -> None:
    """Stored tables hold what the same operators give on frames."""
    from fleetlens.catalog import relational  # noqa: F401

    for stored, plain in (("a9_stored_upsert", "a9_config_upsert"), ("a10_stored_insert", "a10_insert_missing"), ("a8_stored_resolve", "a8_resolve_incidents")):
        SQL[stored] = SQL[plain]


_twins()


def _twin_of_forecast() -> None:
    """A stored model forecasts what a fresh one does."""
    from fleetlens.catalog import models  # noqa: F401

    SQL["k24_stored_forecaster"] = SQL["k12_forecast"]


_twin_of_forecast()
