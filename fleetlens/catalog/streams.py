"""Streaming queries (inventory group J): the event table as a stream, drained to a table and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from fleetlens.catalog import relational, timeseries  # noqa: F401  (their twins are used here)
from fleetlens.catalog.base import SQL, R, query
from fleetlens.catalog.operations import _BREAKER, _chain
from fleetlens.functions.numeric import fixed
from fleetlens.session import checkpoint_dir
from fleetlens.sources import tables as t
from fleetlens.streaming import streams as st


def _events(spark, p):
    """The events as a stream of incident rows."""
    schema = t.table(spark, p, "events").schema
    # A pattern, since a stream source takes a folder or a pattern but no single file.
    # The trigger size bounds what the state function of one key gets at a time.
    source = spark.readStream.schema(schema).option("maxBytesPerTrigger", 256 * 1024 * 1024)
    raw = source.parquet(f"{p}/events.parquet*")
    return raw.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("type"),
        F.concat(F.lit("svc_"), (F.col("user_id") % 4).cast("string")).alias("service_name"), "value",
    )


def _delay(spark, p) -> str:
    """A watermark delay that drops no row of the table, however its files lie."""
    return f"{max(600, st.largest_disorder(t.table(spark, p, 'events'), 'ts'))} seconds"


def _home(spark) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid4().hex}"


def _timed(spark, p, home, rows):
    """A stream over the whole table that `_drained` ends, with its watermark."""
    return st.with_event_time(st.until_end(rows, f"{home}/end"), delay=_delay(spark, p))


def _drained(df, home, *ends):
    ends = [f"{home}/{name}" for name in ends or ("end",)]
    out = st.drain(df, f"{home}/out", f"{home}/state", end=ends, may_drop=False).drop("batch")
    return out.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in out.schema if f.dataType.typeName() == "timestamp"})


# Detections of single events: `signup` rows stand for failed polls.
_FOUND = """select service_name, timestamp, 'health_check_failed' as type, 'CRITICAL' as severity, id from incident_events where type = 'signup'
 union all select service_name, timestamp, 'cpu_spike', case when value > 80*1.2 then 'CRITICAL' else 'WARNING' end, id from incident_events where type <> 'signup' and value > 80
 union all select service_name, timestamp, 'high_error_rate', case when value/100 > 0.2*3 then 'CRITICAL' else 'WARNING' end, id from incident_events where type <> 'signup' and value/100 > 0.2"""


@query("j1_detection_stream", f"select service_name, type, timestamp, 'restart_container' as action_type from ({_chain(_FOUND, ['service_name', 'type'], 600)}) q")
def j1(spark, p):
    health = _events(spark, p).select(
        "service_name", "timestamp", (F.col("type") != "signup").alias("reachable"),
        F.col("value").alias("cpu_usage_percent"), (F.col("value") / 100).alias("error_rate"),
    )
    home = _home(spark)
    out = st.detections(health, _delay(spark, p), window_s=600, end=f"{home}/end")
    return _drained(out, home).select("service_name", "type", "timestamp", "action_type")


@query("j2_dedupe_stream", _chain("select * from incident_events", ["type"], 600))
def j2_stream(spark, p):
    home = _home(spark)
    return _drained(st.dedupe_stream(_timed(spark, p, home, _events(spark, p)), ["type"], window_s=600), home).select("id", "type", "timestamp")


@query("j4_breaker_stream", _BREAKER.replace("type in ('error', 'click') as restart", "true as restart")
    + "select id, service_name, timestamp, why is null as allowed, why as denied_by, st as breaker_state, failures as failure_count, make_timestamp(opened) as opened_at from k where n > 0")
def j4_stream(spark, p):
    e = _events(spark, p).select("id", "timestamp", "service_name", F.lit("restart_container").alias("action_type"), (F.col("value") < 30).alias("success"))
    home = _home(spark)
    out = _drained(st.breaker_stream(_timed(spark, p, home, e), window_s=3600, cooldown_s=1200), home)
    return out.select("id", "service_name", "timestamp", "allowed", "denied_by", "breaker_state", "failure_count", "opened_at")


@query("j7_live_metrics", f"""select service_name, time_bucket(interval 2 second, timestamp) as window_start, count(*) as total_requests, count(*) filter (type = 'error') as total_errors,
  {R("avg(value)", 2)} as avg_value, {R("count(*) filter (type = 'error')/count(*)")} as error_rate from incident_events group by 1, 2""")
def j7(spark, p):
    home = _home(spark)
    return _drained(st.live_metrics(_timed(spark, p, home, _events(spark, p)), "2 seconds"), home)


@query("j8_sliding_rates", f"""with s as (select service_name, type, unnest(range(cast(floor(epoch_us(timestamp)/30000000.0) as bigint) - 9, cast(floor(epoch_us(timestamp)/30000000.0) as bigint) + 1)) as c from incident_events)
select service_name, type, make_timestamp(c*30000000 + 300000000) as timestamp, {R("count(*)/300.0", 6)} as rate from s group by 1, 2, c""")
def j8(spark, p):
    home = _home(spark)
    out = _drained(st.sliding_rates(_timed(spark, p, home, _events(spark, p))), home)
    return out.withColumn("rate", fixed("rate", 6))


@query("j8_counter_rates")
def j8_counters(spark, p):
    """Rates of counters in two streams: growth of every sample, resets included, then sliding windows over it."""
    home = _home(spark)
    keys = ["service", "event_type", "status"]
    t.counters(spark, p).repartitionByRange("timestamp").write.parquet(f"{home}/samples")
    samples = spark.read.parquet(f"{home}/samples")
    live = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 16).parquet(f"{home}/samples")
    timed = st.with_event_time(st.until_end(live, f"{home}/end"), delay=f"{max(600, st.largest_disorder(samples))} seconds")
    grown = _drained(st.increments_stream(timed, keys, tie="event_id"), home).select(*keys, "timestamp", "increment")
    then = f"{home}/windows"
    live = spark.readStream.schema(grown.schema).option("maxFilesPerTrigger", 16).parquet(f"{home}/out/batch=*")
    ended = st.until_end(live.select(*grown.columns), f"{then}/end")
    delay = f"{max(600, st.largest_disorder(spark.read.parquet(f'{home}/out')))} seconds"
    out = _drained(st.counter_rates(ended, keys, 3600, 600, delay=delay), then)
    return out.select("service", "event_type", "timestamp", fixed("value", 6).alias("value"))


# Equal to the grid of the batch operator.
SQL["j8_counter_rates"] = SQL["e10_grid_rate"]


@query("j9_drop_late", "select id, timestamp from incident_events union all select id, timestamp from incident_events where timestamp > (select date_trunc('milliseconds', max(timestamp)) from incident_events) - interval 168 hour")
def j9(spark, p):
    """The whole table, then all of it again: of the second time only the last 168 hours come in time."""
    home = _home(spark)
    rows = _events(spark, p).select("id", "timestamp")
    both = st.drop_late(st.until_end(rows, f"{home}/again"))
    st.drain(both, f"{home}/out", f"{home}/state")
    t.incident_events(spark, p).select("id", "timestamp").write.mode("append").parquet(f"{home}/again")
    return st.drain(both, f"{home}/out", f"{home}/state").select("id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


def _matched(spark, p, rows, incidents, back_s, ahead_s):
    home = _home(spark)
    delay = _delay(spark, p)
    left = st.with_event_time(st.until_end(rows, f"{home}/end"), delay=delay)
    right = st.with_event_time(st.until_end(incidents, f"{home}/end-right"), delay=delay)
    live = st.match_stream(left, right, [], ["id"], back_s, ahead_s)
    return st.matched_rows(_drained(live, home, "end", "end-right"), ["id"]).select("id", "matched")


def _scored(spark, p):
    """The rows of the scores and predictions views, from the stream of events."""
    return _events(spark, p).select("id", "timestamp", "type", "value")


@query("c3_match_stream")
def c3_stream(spark, p):
    """Anomalies beside incidents within ten minutes, both as streams."""
    rows = _scored(spark, p)
    return _matched(spark, p, rows.where("value > 50").select("id", "timestamp"), rows.where("type = 'error'").select("id", "timestamp"), 600, 600)


@query("c4_match_stream")
def c4_stream(spark, p):
    """Predictions and the incidents of the hour after them, both as streams."""
    rows = _scored(spark, p)
    return _matched(spark, p, rows.where("value / 100 >= 0.4").select("id", "timestamp"), rows.select("id", "timestamp"), 0, 3600)


SQL["c3_match_stream"], SQL["c4_match_stream"] = SQL["c3_match_anomalies"], SQL["c4_match_predictions"]


@query("c8_threshold_versions", f"""with v as (select service_name, cast(date_trunc('day', timestamp) + interval 1 day as timestamp) as valid_from, {R("max(cpu_usage_percent)*0.9")} as cpu_limit from metrics_wide group by 1, 2),
 u as (select *, lead(valid_from) over (partition by service_name order by valid_from) as valid_to from v)
select m.service_name, m.timestamp, cpu_limit, m.cpu_usage_percent > coalesce(cpu_limit, 80) as over_limit from metrics_wide m left join u
 on u.service_name = m.service_name and m.timestamp >= valid_from and (valid_to is null or m.timestamp < valid_to)""")
def c8_versions(spark, p):
    """Live metrics beside the limit of their service that is valid at their time: nine tenths of the former day's peak."""
    home, m = _home(spark), t.metrics_wide(spark, p).select("service_name", "timestamp", "cpu_usage_percent")
    m.repartitionByRange("timestamp").write.parquet(f"{home}/metrics")
    day = (F.date_trunc("day", "timestamp") + F.expr("interval 1 day")).cast("timestamp_ntz")
    m.groupBy("service_name", day.alias("valid_from")).agg(fixed(F.max("cpu_usage_percent") * 0.9).alias("cpu_limit")).write.parquet(f"{home}/limits")
    live = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 16).parquet(f"{home}/metrics")
    over = lambda df: df.select("service_name", "timestamp", "cpu_limit", (F.col("cpu_usage_percent") > F.coalesce("cpu_limit", F.lit(80))).alias("over_limit"))
    sink = st.versioned_sink(f"{home}/out", lambda s: s.read.parquet(f"{home}/limits"), ["service_name"], then=over)
    live.writeStream.foreachBatch(sink).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return st.read_sink(spark, f"{home}/out").drop("batch")
