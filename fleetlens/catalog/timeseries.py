"""Queries for windows, rates, alerts and features (inventory groups E, I10 and K1 to K4, K7, K10, K16)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from fleetlens.catalog.base import SQL, R, query
from fleetlens.catalog.operations import _BREAKER, _replayed
from fleetlens.functions.numeric import fixed, flag
from fleetlens.operators import features as ft
from fleetlens.operators import promlike as prom
from fleetlens.operators import windows as win
from fleetlens.plans.ordered import running
from fleetlens.session import checkpoint_dir
from fleetlens.sources import tables as t
from fleetlens.sources.partitions import read_table

KEY = ["service_name", "timestamp"]
FIVE = ft.ROLLING_METRICS
FOUR = ft.LAG_METRICS
THREE = ["cpu_usage_percent", "memory_usage_mb", "error_rate"]


def _r4(df, keep):
    return df.select(*keep, *[fixed(c).alias(c) for c in df.columns if c not in keep])


# Window text of the SQL twins.
_W = "partition by service_name order by timestamp"
_SQLSTAT = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def _roll(m, n, s):
    return f"{_SQLSTAT[s]}({m}) over ({_W} rows between {n - 1} preceding and current row)"


def _lag(m, k):
    return f"lag({m}, {k}) over ({_W})"


def _pct(m, p):
    return f"case when {p} = 0 then 0 else {m}/{p} - 1 end"


_ROLL = {f"{m}_rolling_{s}_{n}": _roll(m, n, s) for m in FIVE for n in ft.SIZES for s in _SQLSTAT}
_Z = {f"{m}_zscore_{n}": f"({m} - {_roll(m, n, 'mean')})/({_roll(m, n, 'std')} + 1e-6)" for m in FIVE for n in ft.SIZES}
_LAGS = {f"{m}_lag_{k}": _lag(m, k) for m in FOUR for k in ft.STEPS}
_RATES = {
    k: v
    for m in THREE
    for k, v in {
        f"{m}_diff": f"{m} - {_lag(m, 1)}",
        f"{m}_pct_change": _pct(m, _lag(m, 1)),
        f"{m}_acceleration": f"{m} - 2*{_lag(m, 1)} + {_lag(m, 2)}",
    }.items()
}


def _cols(d):
    return ", ".join(f"{R(v)} as {k}" for k, v in d.items())


@query("e1_rolling", f"select service_name, timestamp, {_cols(_ROLL)} from metrics_wide")
def e1(spark, p):
    out = win.rolling(t.metrics_wide(spark, p), FIVE)
    return _r4(out.select(*KEY, *_ROLL), KEY)


@query("e2_rolling_z", f"select service_name, timestamp, {_cols(_Z)} from metrics_wide")
def e2(spark, p):
    return _r4(win.rolling_z(t.metrics_wide(spark, p), FIVE).select(*KEY, *_Z), KEY)


@query("e3_lags", f"select service_name, timestamp, {_cols(_LAGS)} from metrics_wide")
def e3(spark, p):
    return _r4(win.lags(t.metrics_wide(spark, p), FOUR).select(*KEY, *_LAGS), KEY)


@query("e4_rates", f"select service_name, timestamp, {_cols(_RATES)} from metrics_wide")
def e4(spark, p):
    return _r4(win.rates(t.metrics_wide(spark, p), THREE).select(*KEY, *_RATES), KEY)


@query("e5_rate_of_change", f"select service_name, timestamp, {R('coalesce(cpu_usage_percent - ' + _lag('cpu_usage_percent', 1) + ', 0)')} as cpu_usage_percent_rate_of_change from metrics_wide")
def e5(spark, p):
    out = win.rate_of_change(t.metrics_wide(spark, p), ["cpu_usage_percent"], 0.0)
    return _r4(out.select(*KEY, "cpu_usage_percent_rate_of_change"), KEY)


_PIVOT = "select service, timestamp, " + ", ".join(f"avg(value) filter (metric_name = '{m}') as {m}" for m in t.LONG_METRICS) + " from metrics_long group by 1, 2"
_FILL = ", ".join(f"coalesce(last_value({m} ignore nulls) over (partition by service order by timestamp rows between unbounded preceding and current row), 0) as {m}" for m in t.LONG_METRICS)


@query("e6_forward_fill", f"with pv as ({_PIVOT}), fl as (select service, timestamp, {_FILL} from pv) select service, timestamp, {', '.join(f'{R(m)} as {m}' for m in t.LONG_METRICS)} from fl")
def e6(spark, p):
    wide = t.metrics_long(spark, p).groupBy("service", "timestamp").pivot("metric_name", t.LONG_METRICS).agg(F.avg("value"))
    return _r4(win.ffill(wide, t.LONG_METRICS, ["service"]).select("service", "timestamp", *t.LONG_METRICS), ["service", "timestamp"])


_LB = {f"{m}_{s}": ("coalesce(%s, 0)" if s == "std" else "%s") % _roll(m, 12, s) for m in THREE for s in _SQLSTAT}


@query("e7_lookback", f"select service_name, timestamp, {_cols(_LB)} from metrics_wide")
def e7(spark, p):
    return _r4(win.lookback(t.metrics_wide(spark, p), THREE).select(*KEY, *_LB), KEY)


@query("e8_system_health", """select service_name, timestamp as last_updated, error_rate as current_error_rate, cpu_usage_percent as current_cpu_percent
from (select *, row_number() over (partition by service_name order by timestamp desc) as rn from metrics_wide) q where rn = 1""")
def e8(spark, p):
    return win.system_health(t.metrics_wide(spark, p))


@query("e9_latest_score", "select id, timestamp, anomaly_score, is_anomaly, label from scores order by timestamp desc, id desc limit 1")
def e9(spark, p):
    return win.latest_score(t.scores(spark, p))


@query("e9_latest_score_by_label", "select id, timestamp, anomaly_score, label from (select *, row_number() over (partition by label order by timestamp desc, id desc) as rn from scores) q where rn = 1")
def e9_by(spark, p):
    return win.latest_score(t.scores(spark, p), ["label"]).select("id", "timestamp", "anomaly_score", "label")


_SERIES = ["service", "event_type", "status"]
_INC = """inc as (select *, case when value < prev then value else coalesce(value - prev, 0) end as d from
 (select *, lag(value) over (partition by service, event_type order by timestamp, event_id) as prev from counters) q)"""


def _rate_sql(seconds, factor):
    return f"""with {_INC} select service, event_type, event_id, {R(f"{factor}*sum(d) over (partition by service, event_type order by epoch_us(timestamp) range between {seconds * 1000000 - 1} preceding and current row)/{seconds}.0", 6)} as"""


@query("e10_counter_rate", _rate_sql(3600, 1) + " rate from inc")
def e10(spark, p):
    out = prom.counter_rate(t.counters(spark, p), _SERIES, 3600, by=("timestamp", "event_id"))
    return out.select("service", "event_type", "event_id", fixed("rate", 6).alias("rate"))


@query("e10_grid_rate", f"""with {_INC}, c as (select service, event_type, cast(ceil(epoch_us(timestamp)/600000000.0) as bigint) as g, sum(d) as d from inc group by 1, 2, 3),
 x as (select service, event_type, d, unnest(range(g, g + 6)) as g from c)
select service, event_type, make_timestamp(g*600000000) as timestamp, {R("sum(d)/3600.0", 6)} as value from x group by 1, 2, 3""")
def e10_grid(spark, p):
    out = prom.grid_rate(t.counters(spark, p), _SERIES, 3600, 600, by=("timestamp", "event_id"))
    return out.select("service", "event_type", "timestamp", fixed("value", 6).alias("value"))


@query("e11_counter_increase", _rate_sql(7200, 7200) + " increase from inc")
def e11(spark, p):
    out = prom.counter_increase(t.counters(spark, p), _SERIES, 7200, by=("timestamp", "event_id"))
    return out.select("service", "event_type", "event_id", fixed("increase", 6).alias("increase"))


@query("e12_alert_states", """with b as (select service_name, timestamp, cpu_usage_percent > 55 as on_, lag(cpu_usage_percent > 55, 1, false) over (partition by service_name order by timestamp) as was from metrics_wide),
 r as (select *, max(case when on_ and not was then timestamp end) over (partition by service_name order by timestamp rows between unbounded preceding and current row) as since from b)
select service_name, timestamp, case when not on_ then 'inactive' when epoch(timestamp) - epoch(since) >= 7200 then 'firing' else 'pending' end as state, case when on_ then since end as active_since from r""")
def e12(spark, p):
    m = t.metrics_wide(spark, p)
    out = prom.alert_states(m, ["service_name"], F.col("cpu_usage_percent") > 55, 7200)
    return out.select("service_name", "timestamp", "state", "active_since")


@query("e13_action_counts", """select id, service_name, type, count(*) over (partition by service_name, type order by timestamp range between interval 300 second preceding and current row) as recent_actions from incident_events""")
def e13(spark, p):
    out = prom.action_counts(t.incident_events(spark, p), ["service_name", "type"])
    return out.select("id", "service_name", "type", "recent_actions")


@query("e14_log_rate", f"""select service, time_bucket(interval 10 minute, timestamp) as window_start, {R("count(*)/600.0", 6)} as rate from logs where line like '%ERROR%' group by 1, 2""")
def e14(spark, p):
    from fleetlens.operators.filters import line_filter

    out = prom.log_rate(line_filter(t.logs(spark, p), "ERROR"), "10 minutes", 600, ["service"])
    return out.select("service", F.col("window_start").cast("timestamp_ntz").alias("window_start"), fixed("rate", 6).alias("rate"))


@query("e15_recording_rule", f"""with {_INC}, c as (select service, event_type, cast(ceil(epoch_us(timestamp)/1800000000.0) as bigint) as g, sum(d) as d from inc group by 1, 2, 3),
 x as (select service, event_type, d, unnest(range(g, g + 2)) as g from c)
select service, event_type, make_timestamp(g*1800000000) as timestamp, {R("sum(d)/3600.0", 6)} as value, 'job:event_rate:1h' as record from x group by 1, 2, 3""")
def e15(spark, p):
    out = prom.recording_rule(
        t.counters(spark, p), "job:event_rate:1h", lambda d: prom.grid_rate(d, _SERIES, 3600, 1800, by=("timestamp", "event_id"))
    )
    return out.select("service", "event_type", "timestamp", fixed("value", 6).alias("value"), "record")


@query("e15_updated_rule")
def e15_updated(spark, p):
    """The same rule evaluated over the first half of the samples, then brought up to date with all of them, twice."""
    home = f"{checkpoint_dir(spark)}/rule-{uuid4().hex}"
    rows, by = t.counters(spark, p), ("timestamp", "event_id")
    for part in (rows.filter(F.col("timestamp") < F.lit("2024-01-16 10:10:00").cast("timestamp_ntz")), rows, rows):
        prom.update_rule(spark, home, part, "job:event_rate:1h", lambda d: prom.grid_rate(d, _SERIES, 3600, 1800, by=by), _SERIES, 3600, by)
    return read_table(spark, home).select("service", "event_type", "timestamp", fixed("value", 6).alias("value"), "record")


SQL["e15_updated_rule"] = SQL["e15_recording_rule"]


@query("e16_instant", """with g as (select service, event_type, event_id, timestamp as seen, value, unnest(range(cast(ceil(epoch_us(timestamp)/60000000.0) as bigint), cast(ceil(epoch_us(timestamp)/60000000.0) as bigint) + 6)) as g from counters),
 f as (select *, row_number() over (partition by service, event_type, g order by seen desc, event_id desc) as rn from g where g*60000000 - epoch_us(seen) <= 300000000)
select service, event_type, make_timestamp(g*60000000) as timestamp, value from f where rn = 1""")
def e16(spark, p):
    out = prom.instant(t.counters(spark, p), _SERIES, 60, 300, by=("timestamp", "event_id"))
    return out.select("service", "event_type", "timestamp", "value")


def _samples(spark, p):
    """Metric samples for the rules: request counters, cpu and memory gauges, request-time buckets."""
    c = t.counters(spark, p)
    labels = F.create_map(F.lit("service"), F.col("service"), F.lit("event_type"), F.col("event_type"), F.lit("status"), F.col("status"))
    reqs = c.select("timestamp", F.lit("http_requests_total").alias("metric"), labels.alias("labels"), F.col("value").cast("double").alias("value"))
    m = t.metrics_wide(spark, p)
    gauge = F.array(
        F.struct(F.lit("cpu_usage_percent").alias("metric"), F.col("cpu_usage_percent").alias("value")),
        F.struct(F.lit("memory_usage_percent").alias("metric"), F.col("memory_usage_percent").alias("value")),
        F.struct(F.lit("response_time_p95_ms").alias("metric"), F.col("response_time_p95").alias("value")),
    )
    g = m.select("timestamp", F.create_map(F.lit("service"), F.col("service_name")).alias("labels"), F.inline(gauge)).select("timestamp", "metric", "labels", "value")
    h = t.hist_buckets(spark, p)
    b = h.select(
        "timestamp", F.lit("http_request_duration_seconds_bucket").alias("metric"),
        F.create_map(F.lit("service"), F.col("service"), F.lit("le"), F.col("le").cast("string")).alias("labels"),
        F.col("cum").cast("double").alias("value"),
    )
    return reqs.unionByName(g).unionByName(b)


def _total(rows, metric, keys, steps):
    """Samples of an ever growing counter with the labels `keys`: the sum of `steps` so far at every moment with rows."""
    at = rows.groupBy(*keys, "timestamp").agg(F.sum(steps).alias("_n"))
    labels = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))])
    grown = running(at, keys, ["timestamp"], sums={"_total": F.col("_n")})
    return grown.select("timestamp", F.lit(metric).alias("metric"), labels.alias("labels"), F.col("_total").cast("double").alias("value"))


def _gauge(rows, metric, labels, value):
    """Samples of a gauge, the worst (largest) where several rows of a series share a moment."""
    at = rows.groupBy(F.col("service_name").alias("service"), "timestamp").agg(value.alias("value"))
    return at.select("timestamp", F.lit(metric).alias("metric"), labels.alias("labels"), F.col("value").cast("double").alias("value"))


def _other_samples(spark, p):
    """Samples of the metrics that `_samples` lacks, over whole tables. An event's value is its CPU seconds, a
    `signup` stands for a failed poll, and of the services only svc_0 and svc_1 have a job, which the rule on `up` asks for."""
    service = F.create_map(F.lit("service"), F.col("service"))
    job = F.create_map(F.lit("service"), F.col("service"), F.lit("job"), F.lit("flask-app"))
    e = t.incident_events(spark, p).withColumn("service", F.col("service_name"))
    ra = t.remediation_actions(spark, p)
    m = t.metrics_wide(spark, p)
    parts = [
        _total(e, "process_cpu_seconds_total", ["service"], F.col("value")),
        _total(e, "database_errors_total", ["service"], flag(F.col("type") == "error")),
        _total(ra, "remediation_actions_total", ["target", "action_type"], F.lit(1)),
        _total(ra, "remediation_failures_total", ["target"], flag(~F.col("success"))),
        _total(t.incidents(spark, p), "incidents_total", ["affected_service"], F.lit(1)),
        _gauge(m, "process_resident_memory_bytes", service, F.max(F.col("memory_usage_mb") * 1e6)),
        _gauge(m, "error_percent", service, F.max(F.col("error_rate") * 100)),
        _gauge(e, "up", F.when(F.col("service").isin("svc_0", "svc_1"), job).otherwise(service), 1 - F.max(flag(F.col("type") == "signup"))),
        _gauge(_replayed(spark, p), "circuit_breaker_state", service, F.max(flag(F.col("breaker_state") == "OPEN"))),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("i10_gauge_rules", """with g as (select 'CPUExhaustion' as alert, service_name, timestamp, cpu_usage_percent as v, 90.0 as b, 'critical' as severity from metrics_wide
 union all select 'MemoryExhaustion', service_name, timestamp, memory_usage_percent, 85.0, 'warning' from metrics_wide
 union all select 'SlowResponses', service_name, timestamp, response_time_p95, 500.0, 'warning' from metrics_wide),
 x as (select *, unnest(range(0, 6)) as k from g)
select alert, concat('service=', service_name) as series, timestamp + to_seconds(60*k) as timestamp, v as value, case when v > b then 'firing' else 'inactive' end as state, severity from x""")
def i10_gauges(spark, p):
    chosen = [r for r in prom.RULES if r[0] in ("CPUExhaustion", "MemoryExhaustion", "SlowResponses")]
    return prom.evaluate_rules(_samples(spark, p), chosen, step=60).select("alert", "series", "timestamp", "value", "state", "severity")


# A rule on a counter rate: half-hour grid, two-hour window, on for an hour before it fires.
_BUSY = ("BusyErrors", "http_requests_total", [("status", "=~", "5..")], "rate", 7200, ">", 0.0008, 3600, "critical", "app", "Many errors")


@query("i10_rate_rule", f"""with {_INC}, c as (select service, event_type, cast(ceil(epoch_us(timestamp)/1800000000.0) as bigint) as g, sum(d) as d from inc where status = '500' group by 1, 2, 3),
 x as (select service, event_type, d, unnest(range(g, g + 4)) as g from c),
 v as (select 'event_type=' || event_type || ',service=' || service || ',status=500' as series, make_timestamp(g*1800000000) as timestamp, sum(d)/7200.0 as value from x group by 1, 2),
 o as (select *, value > 0.0008 as on_, lag(value > 0.0008, 1, false) over (partition by series order by timestamp) as was from v),
 b as (select *, max(case when on_ and not was then timestamp end) over (partition by series order by timestamp rows between unbounded preceding and current row) as since from o)
select series, timestamp, {R("value", 6)} as value, case when not on_ then 'inactive' when epoch(timestamp) - epoch(since) >= 3600 then 'firing' else 'pending' end as state from b""")
def i10_rate(spark, p):
    out = prom.evaluate_rules(_samples(spark, p), [_BUSY], step=1800)
    return out.select("series", "timestamp", fixed("value", 6).alias("value"), "state")


def _all_rules_sql() -> str:
    """Samples, growth, values and states of all rules on a grid of 300 s, written independently."""

    def total(metric, rows, labels, keys, steps):
        by = ", ".join(keys)
        return f"""select '{metric}' as metric, {labels} as series, null::double as le, timestamp, cast(sum(n) over (partition by {by} order by timestamp rows between unbounded preceding and current row) as double) as v
 from (select {by}, timestamp, {steps} as n from {rows} group by all) q"""

    def gauge(metric, rows, value, labels="'service=' || service_name"):
        return f"select '{metric}', {labels}, null, timestamp, cast({value} as double) from {rows} group by service_name, timestamp"

    samples = [
        "select 'http_requests_total' as metric, 'event_type=' || event_type || ',service=' || service || ',status=' || status as series, null::double as le, timestamp, cast(value as double) as v from counters",
        *[f"select '{m}', 'service=' || service_name, null, timestamp, cast({c} as double) from metrics_wide" for m, c in (("cpu_usage_percent", "cpu_usage_percent"), ("memory_usage_percent", "memory_usage_percent"), ("response_time_p95_ms", "response_time_p95"))],
        "select 'http_request_duration_seconds_bucket', 'service=' || service, le, timestamp, cast(cum as double) from hist_buckets",
        total("process_cpu_seconds_total", "incident_events", "'service=' || service_name", ["service_name"], "sum(value)"),
        total("database_errors_total", "incident_events", "'service=' || service_name", ["service_name"], "count(*) filter (type = 'error')"),
        total("remediation_actions_total", "remediation_actions", "'action_type=' || action_type || ',target=' || target", ["target", "action_type"], "count(*)"),
        total("remediation_failures_total", "remediation_actions", "'target=' || target", ["target"], "count(*) filter (not success)"),
        total("incidents_total", "incidents", "'affected_service=' || affected_service", ["affected_service"], "count(*)"),
        gauge("process_resident_memory_bytes", "metrics_wide", "max(memory_usage_mb * 1e6)"), gauge("error_percent", "metrics_wide", "max(error_rate * 100)"),
        gauge("up", "incident_events", "1 - max((type = 'signup')::int)", "case when service_name in ('svc_0', 'svc_1') then 'job=flask-app,' else '' end || 'service=' || service_name"),
        gauge("circuit_breaker_state", "k where n > 0", "max((st = 'OPEN')::int)"),
    ]
    match = {"HighErrorRate": "%status=5__", "ApplicationDown": "job=flask-app,%"}
    rules = ", ".join(f"('{name}', '{metric}', '{match.get(name, '%')}', '{fn}', {window}, '{op}', {bound}::double, {hold}, '{severity}')" for name, metric, _, fn, window, op, bound, hold, severity, _, _ in prom.RULES)
    return _BREAKER + f""", sm as ({" union all ".join(samples)}),
 inc as (select *, case when v < prev then v else coalesce(v - prev, 0) end as d from (select *, lag(v) over (partition by metric, series, le order by timestamp) as prev from sm) q),
 pane as (select metric, series, le, cast(ceil(epoch_us(timestamp)/300000000.0) as bigint) as c, sum(d) as d, max_by(v, timestamp) as newest, max(timestamp) as seen from inc group by 1, 2, 3, 4),
 rules(alert, metric, match, fn, w, op, bound, hold, severity) as (values {rules}),
 grown as (select p.metric, series, le, w, g, sum(d) as d from (select p.*, r.w, unnest(range(c, c + r.w // 300)) as g from pane p join (select distinct metric, w from rules where w > 0) r on r.metric = p.metric) p group by 1, 2, 3, 4, 5),
 b as (select metric, series, w, g, le, d/w as cum, lag(le, 1, 0) over x as lo, lag(d/w, 1, 0) over x as below, row_number() over x as pos,
  last_value(d/w) over (partition by metric, series, w, g order by le rows between unbounded preceding and unbounded following) as total from grown where le is not null window x as (partition by metric, series, w, g order by le)),
 p95 as (select metric, series, w, g, case when total <> 0 then lo + (le - lo)*(0.95*total - below)/nullif(cum - below, 0) end as v
  from (select *, count(*) filter (cum < 0.95*total) over (partition by metric, series, w, g) as i from b) q where pos = i + 1),
 latest as (select metric, series, g, max_by(newest, seen) as v from (select *, unnest([c, c + 1]) as g from pane) q where g*300000000 - epoch_us(seen) <= 300000000 group by 1, 2, 3),
 vals as (select 'rate' as fn, metric, series, w, g, d/w as v from grown where le is null union all select 'increase', metric, series, w, g, d from grown where le is null
  union all select 'p95', metric, series, w, g, v from p95 union all select 'value', metric, series, 0, g, v from latest),
 o as (select alert, series, hold, severity, g, coalesce(case op when '>' then v > bound else v = bound end, false) as on_ from vals join rules using (metric, fn, w) where series like match),
 l as (select *, lag(on_, 1, false) over (partition by alert, series order by g) as was from o),
 z as (select *, max(case when on_ and not was then g end) over (partition by alert, series order by g rows between unbounded preceding and current row) as since from l)
select alert, case when not on_ then 'inactive' when (g - since)*300 >= hold then 'firing' else 'pending' end as state, severity, count(*) as evaluations from z group by 1, 2, 3"""


@query("i10_all_rules", _all_rules_sql())
def i10_all(spark, p):
    samples = _samples(spark, p).unionByName(_other_samples(spark, p))
    out = prom.evaluate_rules(samples, step=300)
    return out.groupBy("alert", "state", "severity").agg(F.count("*").alias("evaluations"))


# ---- K: features ----------------------------------------------------------------------------------

_CAL = {
    "hour": "hour(timestamp)",
    "day_of_week": "isodow(timestamp) - 1",
    "is_weekend": "case when isodow(timestamp) >= 6 then 1 else 0 end",
    "is_business_hours": "case when hour(timestamp) between 9 and 17 then 1 else 0 end",
    "hour_sin": "sin(2*pi()*hour(timestamp)/24)",
    "hour_cos": "cos(2*pi()*hour(timestamp)/24)",
    "day_sin": "sin(2*pi()*(isodow(timestamp) - 1)/7)",
    "day_cos": "cos(2*pi()*(isodow(timestamp) - 1)/7)",
}
_MIX = {
    "cpu_error_interaction": "cpu_usage_percent*error_rate",
    "memory_latency_interaction": "memory_usage_mb*response_time_p95",
    "combined_load": "(cpu_usage_percent + memory_usage_percent)/2",
    "error_latency_interaction": "error_rate*response_time_p95",
}
_IND = {
    "high_cpu_indicator": "(cpu_usage_percent > 80)::int",
    "high_memory_indicator": "(memory_usage_percent > 85)::int",
    "high_error_indicator": "(error_rate > 0.05)::int",
    "high_latency_indicator": "(response_time_p95 > 1000)::int",
}
_IND["multiple_issues_indicator"] = f"(({' + '.join(_IND.values())}) >= 2)::int"
_ALL = {**_CAL, **_ROLL, **_Z, **_LAGS, **_RATES, **_MIX, **_IND}


@query("k1_extract_features", f"select * from (select service_name, timestamp, {_cols(_ALL)} from metrics_wide) q where cpu_usage_percent_lag_30 is not null")
def k1(spark, p):
    return _r4(ft.extract_features(t.metrics_wide(spark, p)).select(*KEY, *_ALL), KEY)


@query("k2_training_prep", f"""select label, count(*) as n from (select service_name, timestamp, case when error_count > 0 then 1 else 0 end as label, {_lag('cpu_usage_percent', 30)} as back from metrics_wide) q where back is not null group by 1""")
def k2(spark, p):
    m = t.metrics_wide(spark, p).withColumn("label", F.when(F.col("error_count") > 0, "failing").otherwise("normal"))
    f = ft.encode_labels(ft.extract_features(m))
    vec = ft.assemble(f, ft.feature_columns(f))
    return vec.filter(F.col("features").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))


@query("k3_prediction_prep", "select service_name, timestamp, cpu_usage_percent, 0.0::double as not_collected, error_rate from metrics_wide")
def k3(spark, p):
    return ft.align_for_prediction(t.metrics_wide(spark, p), ["cpu_usage_percent", "not_collected", "error_rate"])


_SC = ["cpu_usage_percent", "memory_usage_mb", "error_rate", "response_time_p95"]


def _scaled_sql(m):
    return f"({m} - (select avg({m}) from metrics_wide))/(select case when stddev_pop({m}) = 0 then 1 else stddev_pop({m}) end from metrics_wide)"


@query("k4_scaler", f"select service_name, timestamp, {', '.join(f'{R(_scaled_sql(m))} as {m}' for m in _SC)} from metrics_wide")
def k4(spark, p):
    m = t.metrics_wide(spark, p).select(*KEY, *_SC)
    return _r4(ft.apply_scaler(m, ft.fit_scaler(m, _SC), _SC), KEY)


@query("k7_contributions", f"""with s as (select service_name, timestamp, {', '.join(f'abs({_scaled_sql(m)}) as {m}' for m in _SC)} from metrics_wide)
select service_name, timestamp, {R("greatest(" + ", ".join(_SC) + ")/(" + " + ".join(_SC) + ")")} as top_share,
 case greatest({", ".join(_SC)}) {" ".join(f"when {m} then '{m}'" for m in _SC)} end as top_feature from s""")
def k7(spark, p):
    m = t.metrics_wide(spark, p).select(*KEY, *_SC)
    c = ft.contributions(ft.apply_scaler(m, ft.fit_scaler(m, _SC), _SC), _SC)
    top = ft.top_k("contributions", 3)[0]
    return c.select(*KEY, fixed(top["share"]).alias("top_share"), top["feature"].alias("top_feature"))


@query("k10_temporal_split", """select id, case when row_number() over (order by timestamp, id) <= floor((select count(*) from incident_events)*0.8) then 'train' else 'test' end as part from incident_events""")
def k10(spark, p):
    train, test = ft.split(t.incident_events(spark, p))
    return train.select("id", F.lit("train").alias("part")).unionByName(test.select("id", F.lit("test").alias("part")))


@query("k10_random_split")
def k10_random(spark, p):
    train, test = ft.split(t.incident_events(spark, p), temporal=False, by=("id",))
    both = train.select("id", F.lit("train").alias("part")).unionByName(test.select("id", F.lit("test").alias("part")))
    return both.groupBy("part").agg(F.count("*").alias("rows"))


_LW = "partition by service order by timestamp"
_K16 = {}
for _m in t.LONG_METRICS:
    _K16[f"{_m}_current"] = _m
    for _s, _f in _SQLSTAT.items():
        _K16[f"{_m}_{_s}"] = f"coalesce({_f}({_m}) over ({_LW} rows between 11 preceding and current row), 0)"
    _K16[f"{_m}_change_rate"] = f"coalesce({_m} - lag({_m}) over ({_LW}), 0)"
    _K16[f"{_m}_change_pct"] = f"coalesce({_m}/nullif(lag({_m}) over ({_LW}), 0) - 1, 0)"
_K16 |= {
    "cpu_memory_product": "cpu_usage*memory_usage",
    "cpu_memory_ratio": "cpu_usage/(memory_usage + 1)",
    "error_latency_product": "error_rate*response_time",
    "cpu_high": "(cpu_usage > 80)::int",
    "memory_high": "(memory_usage > 85)::int",
    "error_high": "(error_rate > 5)::int",
    **{k: _CAL[k] for k in ("hour", "day_of_week", "is_weekend", "is_business_hours")},
}


@query("k16_failure_features", f"with pv as ({_PIVOT}), fl as (select service, timestamp, {_FILL} from pv) select service, timestamp, {_cols(_K16)} from fl")
def k16(spark, p):
    out = ft.failure_features(t.metrics_long(spark, p), t.LONG_METRICS)
    return _r4(out.select("service", "timestamp", *_K16), ["service", "timestamp"])


@query("d25_feature_stats", """select (select count(*) from metrics_wide) - 30*(select count(distinct service_name) from metrics_wide) as total_samples, 8 as time_features, 60 as rolling_features, 16 as lag_features""")
def d25(spark, p):
    from fleetlens.operators.aggregates import feature_stats

    f = ft.extract_features(t.metrics_wide(spark, p))
    return feature_stats(f, ft.feature_columns(f)).select("total_samples", "time_features", "rolling_features", "lag_features")
