"""Queries for searches, joins and aggregates (inventory groups A to D and G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import R, query
from fleetlens.functions.numeric import fixed, ratio
from fleetlens.operators import aggregates as agg
from fleetlens.operators import filters as flt
from fleetlens.operators import joins as jn
from fleetlens.operators import setops
from fleetlens.sources import ingest, tables as t

INC_NOW = "2001-08-01 00:00:00"
EV_NOW = "2024-01-31 00:00:00"


def _r(df, *cols, digits=4):
    return df.withColumns({c: fixed(c, digits) for c in cols})


# ---- A: sources and sinks -------------------------------------------------------------------------

@query("a2_export_range", """select service_name, timestamp, cpu_usage_percent, error_rate from metrics_wide
where timestamp between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-12 00:00:00'""")
def a2(spark, p):
    df = ingest.export_range(t.metrics_wide(spark, p), "2024-01-05 00:00:00", "2024-01-12 00:00:00")
    return df.select("service_name", "timestamp", "cpu_usage_percent", "error_rate")


@query("a4_alerts_to_incidents", """with lines as (
 select event_id as id, ts, 'HighErrorRate' as n, event_type, value, user_id, event_id % 3 <> 0 as firing, event_id % 5 <> 0 as sev, 0 as k from events
 union all select event_id, ts, '', event_type, value, user_id, true, false, 1 from events)
select id, ts as timestamp, case when k = 1 then 'CPU_SPIKE' else case event_type when 'error' then 'ERROR_RATE' when 'click' then 'CPU_SPIKE'
   when 'view' then 'DATABASE_CONNECTION' when 'purchase' then 'SERVICE_DOWN' else 'SYSTEM_ERROR' end end as type,
  case when not sev then 'WARNING' when value > 50 then 'CRITICAL' else 'INFO' end as severity,
  case when k = 1 then 'CpuErrorBoth' else concat('user ', user_id) end as description, 'ACTIVE' as status
from lines where firing""")
def a4(spark, p):
    return ingest.alerts_to_incidents(t.alerts(spark, p)).select("id", "timestamp", "type", "severity", "description", "status")


@query("a5_log_labels", """select timestamp, event_id, concat('ct_', service) as container, case when line like 'ERROR%' then 'stderr' else 'stdout' end as stream,
  service, line from logs""")
def a5(spark, p):
    raw = t.logs(spark, p).select(
        "timestamp", "event_id", "line",
        F.concat(F.lit("/ct_"), "service").alias("container_name"),
        F.when(F.col("line").startswith("ERROR"), "stderr").otherwise("stdout").alias("stream_name"),
        "service",
    )
    out = ingest.label_logs(raw, container="container_name", stream="stream_name", service="service")
    lab = F.col("labels")
    return out.select("timestamp", "event_id", lab["container"].alias("container"), lab["stream"].alias("stream"), lab["service"].alias("service"), "line")


@query("a6_parse_samples", """select event_id, 'http_requests_total' as metric, service, event_type, status, cast(value as double) as value from counters""")
def a6(spark, p):
    c = t.counters(spark, p)
    text = F.format_string('http_requests_total{service="%s",event_type="%s",status="%s"} %s', "service", "event_type", "status", F.col("value").cast("string"))
    s = ingest.parse_samples(c.select("event_id", text.alias("line")), "line")
    lab = F.col("labels")
    return s.select("event_id", "metric", *[lab[k].alias(k) for k in ("service", "event_type", "status")], "value")


@query("a7_log_incidents", """select service_name as affected_service, type, 'ACTIVE' as status, timestamp,
  concat('{"value":', case when value > 50 then 'true' else 'false' end, '}') as details from incident_events""")
def a7(spark, p):
    d = t.incident_events(spark, p).select("service_name", "type", F.lit("INFO").alias("severity"), "timestamp", "id", F.struct((F.col("value") > 50).alias("value")).alias("details"))
    return ingest.incident_rows(d, key=["id"]).select("affected_service", "type", "status", "timestamp", "details")


@query("a8_resolve_incidents", """with done as (select incident_id, min(timestamp) as resolved_at from remediation_actions where success group by 1)
select i.id, case when d.incident_id is null then i.status else 'RESOLVED' end as status, d.resolved_at,
  case when d.incident_id is null then i.resolution_time_seconds else cast(round(epoch(d.resolved_at) - epoch(i.timestamp)) as int) end as resolution_time_seconds
from incidents i left join done d on d.incident_id = i.id""")
def a8(spark, p):
    out = ingest.resolve_incidents(t.incidents(spark, p), t.remediation_actions(spark, p))
    return out.select("id", "status", "resolved_at", "resolution_time_seconds")


@query("a9_config_upsert", """with u as (select key, value, updated_at, row_number() over (partition by key order by updated_at desc, seq desc) as rn from config_updates)
select coalesce(u.key, c.key) as key, coalesce(u.value, c.value) as value, coalesce(u.updated_at, c.updated_at) as updated_at,
  case when u.key is null then c.updated_by else 'api' end as updated_by
from config_rows c full join (select * from u where rn = 1) u on u.key = c.key""")
def a9(spark, p):
    new = t.config_updates(spark, p).withColumn("updated_by", F.lit("api"))
    return setops.upsert(t.config_rows(spark, p), new, "key", ["updated_at", "seq"])


@query("a10_insert_missing", """with n as (select key, value, updated_at, row_number() over (partition by key order by updated_at, seq) as rn
  from config_updates u where not exists (select 1 from config_rows c where c.key = u.key))
select key, value, updated_at, updated_by from config_rows
union all select key, value, updated_at, 'seed' from n where rn = 1""")
def a10(spark, p):
    new = t.config_updates(spark, p).select("key", "value", "updated_at", F.lit("seed").alias("updated_by"), "seq")
    return setops.insert_missing(t.config_rows(spark, p), new, "key", ["updated_at", "seq"]).drop("seq")


@query("a11_register_model", """with old as (select model_name, count(*) as v from registry where trained_at < timestamp '2001-01-01' group by 1)
select r.id, r.model_name, coalesce(o.v, 0) + row_number() over (partition by r.model_name order by r.trained_at, r.id) as version
from registry r left join old o using (model_name) where r.trained_at >= timestamp '2001-01-01'""")
def a11(spark, p):
    reg = t.registry(spark, p)
    cut = F.lit("2001-01-01").cast("timestamp_ntz")
    old = ingest.number_versions(reg.filter(F.col("trained_at") < cut))
    new = ingest.register_models(old, reg.filter(F.col("trained_at") >= cut))
    return new.select("id", "model_name", "version")


@query("a13_series_guard", """select service, metric_name, count(*) as n from metrics_long where (service, metric_name) in
 (select (service, metric_name) from metrics_long group by service, metric_name having count(*) >= 100) group by 1, 2""")
def a13(spark, p):
    ok = flt.series_with_rows(t.metrics_long(spark, p), ["service", "metric_name"], 100)
    return ok.groupBy("service", "metric_name").agg(F.count("*").alias("n"))


# ---- B: searches ----------------------------------------------------------------------------------

@query("b1_search_incidents", """select * from incidents where timestamp >= timestamp '2001-08-01' - interval 720 hour and status = 'ACTIVE' and severity = 'CRITICAL'
order by timestamp desc, id desc limit 50 offset 10""")
def b1(spark, p):
    return flt.search_incidents(t.incidents(spark, p), INC_NOW, 720, status="active", severity="critical", limit=50, offset=10)


@query("b1_incident_total", """select count(*) as total from incidents where timestamp >= timestamp '2001-08-01' - interval 720 hour and type = 'cpu_spike'""")
def b1_total(spark, p):
    return flt.incident_total(t.incidents(spark, p), INC_NOW, 720, type="cpu_spike")


@query("b2_remediation_history", """select * from remediation_actions where timestamp >= timestamp '2001-08-01' - interval 240 hour
order by timestamp desc, id desc, incident_id desc, action_type desc, target desc, success desc, execution_time_ms desc limit 50 offset 20""")
def b2(spark, p):
    return flt.remediation_history(t.remediation_actions(spark, p), INC_NOW, 240, 50, 20)


@query("b3_recent_metrics", """select service_name, timestamp, cpu_usage_percent, memory_usage_percent, error_rate, response_time_p95 from metrics_wide
where timestamp > timestamp '2024-01-31' - interval 24 hour""")
def b3(spark, p):
    return flt.recent_metrics(t.metrics_wide(spark, p), EV_NOW, 24)


@query("b4_active_models", "select id, model_name, model_type, trained_at, accuracy from registry where is_active")
def b4(spark, p):
    return flt.models(t.registry(spark, p)).select("id", "model_name", "model_type", "trained_at", "accuracy")


_SEV = R("greatest(0.0, least(100.0, 50 - 20*(anomaly_score - 0.02)/0.05))")


def _severe(df):
    raw = F.lit(50.0) - F.lit(20.0) * (F.col("anomaly_score") - 0.02) / 0.05
    return df.withColumn("anomaly_severity", fixed(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))))


@query("b5_anomaly_scores", f"""select id, timestamp, anomaly_score, is_anomaly, {_SEV} as anomaly_severity from scores where {_SEV} >= 60
order by timestamp desc, id desc limit 100""")
def b5(spark, p):
    return flt.anomaly_scores(_severe(t.scores(spark, p)), 100, 60).select("id", "timestamp", "anomaly_score", "is_anomaly", "anomaly_severity")


@query("b5_anomaly_scores_filter_last", f"""select id, {_SEV} as anomaly_severity from (select * from scores order by timestamp desc, id desc limit 100) q where {_SEV} >= 60""")
def b5_last(spark, p):
    return flt.anomaly_scores(_severe(t.scores(spark, p)), 100, 60, filter_first=False).select("id", "anomaly_severity")


@query("b6_failure_alerts", "select * from predictions where risk_level in ('high', 'medium') order by timestamp desc, id desc limit 50")
def b6(spark, p):
    return flt.failure_alerts(t.predictions(spark, p))


@query("b7_training_history", "select id, model_name, trained_at from registry where model_name = 'forecaster' order by trained_at desc, id desc limit 10")
def b7(spark, p):
    return flt.training_history(t.registry(spark, p), "forecaster").select("id", "model_name", "trained_at")


@query("b8_recent_window", """select service_name, timestamp, request_count from metrics_wide m
where timestamp >= (select max(timestamp) from metrics_wide x where x.service_name = m.service_name) - interval 360 minute""")
def b8(spark, p):
    return flt.recent_window(t.metrics_wide(spark, p), 360).select("service_name", "timestamp", "request_count")


def _labelled(df, *cols):
    pairs = [x for c in cols for x in (F.lit(c), F.col(c))]
    return df.withColumn("labels", F.create_map(*pairs))


@query("b9_label_matchers", """select service, event_type, status, timestamp, event_id, value from counters
where status ~ '^(?:5..)$' and event_type <> 'view' and service !~ '^(?:svc_[01])$'""")
def b9(spark, p):
    c = _labelled(t.counters(spark, p), "service", "event_type", "status")
    m = [("status", "=~", "5.."), ("event_type", "!=", "view"), ("service", "!~", "svc_[01]"), ("absent", "=", "")]
    return flt.match_labels(c, m).drop("labels")


@query("b10_line_filter", "select timestamp, event_id, service, line from logs where line like '%ERROR%' and line like '%: 6%'")
def b10(spark, p):
    return flt.line_filter(t.logs(spark, p), "ERROR", ": 6").drop("props")


@query("b11_json_filter", "select event_id, service, props from logs where cast(json_extract(props, '$.k') as double) > 90")
def b11(spark, p):
    return flt.json_filter(t.logs(spark, p), "k", ">", 90, "props").select("event_id", "service", "props")


@query("b12_last_n", """select service_name, timestamp, cpu_usage_percent from
 (select *, row_number() over (partition by service_name order by timestamp desc) as rn from metrics_wide) q where rn <= 20""")
def b12(spark, p):
    return flt.latest(t.metrics_wide(spark, p), ["service_name"], 20).select("service_name", "timestamp", "cpu_usage_percent")


@query("b13_recent_errors", """select * from remediation_actions where not success
order by timestamp desc, id desc, incident_id desc, action_type desc, target desc, execution_time_ms desc limit 3""")
def b13(spark, p):
    return flt.recent_errors(t.remediation_actions(spark, p))


@query("b14_constraints", """select 'severity_domain' as rule, cast(count(*) filter (severity not in ('CRITICAL','HIGH','MEDIUM','WARNING')) as bigint) as violations from incidents
union all select 'status_domain', count(*) filter (status not in ('ACTIVE','RESOLVED')) from incidents
union all select 'type_null', count(*) filter (type is null) from incidents
union all select 'resolution_time_seconds_range', count(*) filter (resolution_time_seconds not between 60 and 3000) from incidents""")
def b14(spark, p):
    rules = {
        **flt.one_of("severity", ["CRITICAL", "HIGH", "MEDIUM", "WARNING"]),
        **flt.one_of("status", ["ACTIVE", "RESOLVED"]),
        **flt.not_null("type"),
        **flt.within("resolution_time_seconds", 60, 3000),
    }
    return flt.constraint_violations(t.incidents(spark, p), rules)


@query("b14_duplicate_keys", "select id, count(*) as copies from remediation_actions group by 1 having count(*) > 1")
def b14_dup(spark, p):
    return flt.duplicate_keys(t.remediation_actions(spark, p), ["id"])


@query("b15_bands", """select service_name, timestamp,
  case when cpu_usage_percent > 80 then 'danger' when cpu_usage_percent > 50 then 'warning' else 'success' end as cpu_band,
  case when error_rate > 0.2 then 'danger' when error_rate > 0.1 then 'warning' else 'success' end as error_band from metrics_wide""")
def b15(spark, p):
    return t.metrics_wide(spark, p).select(
        "service_name", "timestamp",
        flt.band("cpu_usage_percent", flt.CPU_BANDS).alias("cpu_band"),
        flt.band("error_rate", flt.ERROR_BANDS).alias("error_band"),
    )


@query("b16_resolve_config", """with j as (select key, case when json_valid(value) then value end as v from config_rows)
select key, coalesce(cast((v->>'$.thresholds.cpu_percent') as double), 70) as cpu_warning, coalesce(cast((v->>'$.thresholds.cpu_percent') as double), 80) as cpu_critical,
  coalesce(cast((v->>'$.thresholds.error_rate') as double), 0.2) as error_rate,
  case when (v->'$.circuit_breaker') is not null then cast((v->>'$.circuit_breaker.failure_threshold') as double)
    else coalesce(cast((v->>'$.remediation.max_restarts_per_5min') as double), 3) end as failure_threshold from j""")
def b16(spark, p):
    return flt.resolve_config(t.config_rows(spark, p)).select("key", "cpu_warning", "cpu_critical", "error_rate", "failure_threshold")


@query("b17_unread_count", """with top as (select timestamp, id, affected_service, row_number() over (partition by affected_service order by timestamp desc, id desc) as rn from incidents where status = 'ACTIVE'),
reads as (select c_custkey as user_id, concat('svc_', c_custkey % 10) as affected_service, timestamp '2001-07-01' + interval 1 day * (c_custkey % 40) as last_read from customer)
select r.user_id, cast(count(t.id) as int) as unread from reads r left join top t on t.affected_service = r.affected_service and rn <= 8 and t.timestamp > r.last_read group by 1""")
def b17(spark, p):
    k = F.col("c_custkey")
    reads = t.table(spark, p, "customer").select(
        k.alias("user_id"),
        F.concat(F.lit("svc_"), (k % 10).cast("string")).alias("affected_service"),
        (F.lit("2001-07-01").cast("timestamp_ntz") + F.make_dt_interval(days=(k % 40).cast("int"))).alias("last_read"),
    )
    return flt.unread_count(t.incidents(spark, p), reads, 8, ["affected_service"]).select("user_id", "unread")


# ---- C: joins -------------------------------------------------------------------------------------

@query("c1_recent_incidents", """select i.*, count(a.incident_id) as remediation_attempts from incidents i left join remediation_actions a on a.incident_id = i.id
where i.timestamp > timestamp '2001-08-01' - interval 720 hour group by all""")
def c1(spark, p):
    return jn.recent_incidents(t.incidents(spark, p), t.remediation_actions(spark, p), INC_NOW, 720)


@query("c2_incident_detail", """select i.id, i.type, a.timestamp as action_timestamp, a.action_type, a.target, a.success from incidents i left join remediation_actions a on a.incident_id = i.id""")
def c2(spark, p):
    d = jn.incident_detail(t.incidents(spark, p), t.remediation_actions(spark, p))
    return d.select("id", "type", "action_timestamp", "action_type", "target", "success")


_ML_INC = "select ts as timestamp, event_id as id, case when event_type = 'error' then 'ml_anomaly' else event_type end as type, value from events"


def _event_incidents(spark, p):
    return t.incident_events(spark, p).withColumn("type", F.when(F.col("type") == "error", "ml_anomaly").otherwise(F.col("type")))


@query("c3_match_anomalies", """select s.id, exists (select 1 from incident_events i where i.type = 'error'
  and i.timestamp between s.timestamp - interval 10 minute and s.timestamp + interval 10 minute) as matched from scores s where is_anomaly""")
def c3(spark, p):
    return jn.match_anomalies(t.scores(spark, p), _event_incidents(spark, p)).select("id", "matched")


@query("c3_count_matches", """select s.id, (select count(*) from incident_events i where i.type = 'error'
  and i.timestamp between s.timestamp - interval 10 minute and s.timestamp + interval 10 minute) as matches from scores s where is_anomaly""")
def c3_counts(spark, p):
    inc = _event_incidents(spark, p).filter(F.col("type") == "ml_anomaly")
    left = t.scores(spark, p).filter("is_anomaly").select("id", "timestamp")
    return jn.count_matches(left, inc, [], ["id"], 600, 600).select("id", "matches")


@query("c4_match_predictions", """select p.id, exists (select 1 from incident_events i where i.timestamp between p.timestamp and p.timestamp + interval 1 hour) as matched
from predictions p where risk_level in ('high', 'medium')""")
def c4(spark, p):
    return jn.match_predictions(t.predictions(spark, p), t.incident_events(spark, p)).select("id", "matched")


@query("c5_match_forecasts", f"""select f.service, f.metric_name, f.predicted_timestamp, f.predicted_value, m.event_id, m.value from forecasts f
join (select concat('svc_', user_id % 4) as service, ts, event_id, value, case event_type when 'error' then 'error_rate' when 'click' then 'cpu_usage' when 'view' then 'memory_usage'
    when 'purchase' then 'response_time' else 'disk_usage' end as metric_name from events) m
on m.service = f.service and m.metric_name = f.metric_name and m.ts between f.predicted_timestamp - interval 5 minute and f.predicted_timestamp + interval 5 minute""")
def c5(spark, p):
    m = jn.match_forecasts(t.forecasts(spark, p).drop("actual"), t.metrics_long(spark, p, hourly=False))
    return m.select("service", "metric_name", "predicted_timestamp", "predicted_value", "event_id", "value")


@query("c6_label_next_hour", """select m.service_name, m.timestamp, cast(exists (select 1 from incident_events i where i.service_name = m.service_name
  and i.timestamp between m.timestamp and m.timestamp + interval 1 hour) as int) as label from metrics_wide m""")
def c6(spark, p):
    return jn.label_next_hour(t.metrics_wide(spark, p), t.incident_events(spark, p)).select("service_name", "timestamp", "label")


@query("c7_report_bundle", """with ana as (select o_orderkey as incident_id, concat('cause ', l_linenumber) as root_cause, l_shipdate as analyzed_at from orders join lineitem on l_orderkey = o_orderkey),
newest as (select incident_id, root_cause, analyzed_at, row_number() over (partition by incident_id order by analyzed_at desc, root_cause desc) as rn from ana)
select i.id, n.root_cause, n.analyzed_at, a.timestamp as action_timestamp, a.action_type, a.success from incidents i
left join newest n on n.incident_id = i.id and rn = 1 left join remediation_actions a on a.incident_id = i.id""")
def c7(spark, p):
    inc, act = t.incidents(spark, p), t.remediation_actions(spark, p)
    li = t.table(spark, p, "lineitem")
    ana = li.select(
        F.col("l_orderkey").alias("incident_id"),
        F.concat(F.lit("cause "), F.col("l_linenumber").cast("string")).alias("root_cause"),
        F.col("l_shipdate").alias("analyzed_at"),
    )
    return jn.report_bundle(inc, ana, act).select("id", "root_cause", "analyzed_at", "action_timestamp", "action_type", "success")


@query("c8_with_thresholds", """with th as (select concat('svc_', c_custkey % 4) as service_name, max(c_custkey % 40 + 50) as cpu from customer group by 1)
select m.service_name, m.timestamp, m.cpu_usage_percent > th.cpu as breached from metrics_wide m left join th using (service_name)""")
def c8(spark, p):
    k = F.col("c_custkey")
    th = t.table(spark, p, "customer").groupBy(F.concat(F.lit("svc_"), (k % 4).cast("string")).alias("service_name")).agg(
        F.max(k % 40 + 50).alias("th_cpu_percent")
    )
    m = jn.with_thresholds(t.metrics_wide(spark, p), th)
    return m.select("service_name", "timestamp", (F.col("cpu_usage_percent") > F.col("th_cpu_percent")).alias("breached"))


@query("c9_orphans", "select * from remediation_actions where incident_id not in (select id from incidents where status <> 'ACTIVE')")
def c9(spark, p):
    return jn.orphans(t.remediation_actions(spark, p), t.incidents(spark, p).filter(F.col("status") != "ACTIVE"))


@query("c9_cascade", "select a.* from remediation_actions a where incident_id in (select id from incidents where timestamp < timestamp '1996-01-01')")
def c9_cascade(spark, p):
    old = t.incidents(spark, p).filter(F.col("timestamp") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return jn.cascade_delete(t.remediation_actions(spark, p), old)[1]


def _in(a, b):
    return f"exists (select 1 from i where i.service_name = m.service_name and m.timestamp >= i.timestamp + to_seconds({a}) and m.timestamp < i.timestamp + to_seconds({b}))"


@query("c10_tag_phases", f"""with i as (select * from incident_events where type = 'error' and value > 40)
select m.service_name, m.timestamp, case when {_in(0, 600)} then 'cpu_spike_active' when {_in(600, 720)} then 'cpu_spike_remediation'
  when {_in(720, 2520)} then 'cpu_spike_recovery' when {_in(-3600, 0)} then 'cpu_spike_buildup' else 'normal' end as label from metrics_wide m""")
def c10(spark, p):
    inc = t.incident_events(spark, p).filter((F.col("type") == "error") & (F.col("value") > 40))
    return jn.tag_phases(t.metrics_wide(spark, p), inc).select("service_name", "timestamp", "label")


# ---- D: aggregates --------------------------------------------------------------------------------

@query("d1_remediation_stats", f"""select action_type, target, count(*) as total_attempts, count(*) filter (success) as successful,
  {R("100.0*count(*) filter (success)/count(*)", 2)} as success_rate, {R("avg(execution_time_ms)")} as avg_execution_time_ms
from remediation_actions where timestamp > timestamp '2001-08-01' - interval 7 day group by 1, 2""")
def d1(spark, p):
    return _r(agg.remediation_stats(t.remediation_actions(spark, p), INC_NOW), "avg_execution_time_ms")


@query("d2_metric_stats", f"""select service_name, count(*) as total_samples, min(timestamp) as first_sample, max(timestamp) as last_sample,
  {R("(epoch(max(timestamp)) - epoch(min(timestamp)))/3600.0")} as data_duration_hours, {R("avg(cpu_usage_percent)", 2)} as avg_cpu, {R("avg(memory_usage_percent)", 2)} as avg_memory,
  {R("avg(error_rate)")} as avg_error_rate, {R("coalesce(stddev_samp(cpu_usage_percent), 0)", 2)} as std_cpu, {R("coalesce(stddev_samp(memory_usage_percent), 0)", 2)} as std_memory
from metrics_wide group by 1""")
def d2(spark, p):
    return _r(agg.metric_stats(t.metrics_wide(spark, p), ["service_name"]), "data_duration_hours")


_PROFILE = ["cpu_usage_percent", "memory_usage_mb", "error_rate"]


@query("d2_metric_profile", " union all ".join(
    f"select '{m}' as metric, {R(f'avg({m})')} as mean, {R(f'stddev_samp({m})')} as std, min({m}) as min, max({m}) as max from metrics_wide" for m in _PROFILE))
def d2_profile(spark, p):
    return _r(agg.metric_profile(t.metrics_wide(spark, p), _PROFILE), "mean", "std")


@query("d3_ml_summary", f"""select (select count(distinct model_name) from registry where model_name <> 'forecaster') as total_models,
 (select count(*) from registry where model_name <> 'forecaster' and trained_at > timestamp '2001-08-01' - interval 24 hour) as recently_trained,
 (select {R("avg(accuracy)")} from registry where model_name <> 'forecaster') as avg_accuracy,
 (select count(*) from scores where timestamp > timestamp '2001-08-01' - interval 24 hour) as anomaly_detections,
 (select count(*) from predictions where timestamp > timestamp '2001-08-01' - interval 24 hour) as failure_predictions,
 (select count(*) from forecasts where predicted_timestamp > timestamp '2001-08-01' - interval 24 hour) as forecasts,
 (select count(*) from incidents where type in ('ml_anomaly', 'predicted_breach') and timestamp > timestamp '2001-08-01' - interval 24 hour) as ml_incidents_detected""")
def d3(spark, p):
    out = agg.ml_summary(t.registry(spark, p), t.scores(spark, p), t.predictions(spark, p), t.forecasts(spark, p), t.incidents(spark, p), INC_NOW)
    return _r(out, "avg_accuracy")


@query("d4_freshness", f"""select count(*) as metrics_collected, max(timestamp) as latest_metric_timestamp, (select count(*) from registry where is_active) as active_models,
  {R("(epoch(timestamp '2024-01-31 00:03:00') - epoch(max(timestamp)))/60.0", 1)} as data_age_minutes,
  (epoch(timestamp '2024-01-31 00:03:00') - epoch(max(timestamp)))/60.0 < 5 as data_collection_active from metrics_wide""")
def d4(spark, p):
    return agg.freshness(t.metrics_wide(spark, p), t.registry(spark, p), "2024-01-31 00:03:00")


@query("d5_retention_stats", """select count(*) as total_incidents, count(*) filter (timestamp < timestamp '2001-08-01' - interval 180 day) as old_incidents, min(timestamp) as oldest_record,
 (select count(*) from remediation_actions) as total_remediation_actions,
 (select count(*) from remediation_actions where timestamp < timestamp '2001-08-01' - interval 180 day) as old_remediation_actions,
 timestamp '2001-08-01' - interval 180 day as cutoff from incidents""")
def d5(spark, p):
    return agg.retention_stats(t.incidents(spark, p), t.remediation_actions(spark, p), INC_NOW)


@query("d6_summarize_metrics", f"""select service_name, count(*) as sample_count, min(timestamp) as first_sample, max(timestamp) as last_sample,
  min(cpu_usage_percent) as cpu_min, max(cpu_usage_percent) as cpu_max, {R("avg(cpu_usage_percent)")} as cpu_avg,
  min(memory_usage_mb) as memory_min, max(memory_usage_mb) as memory_max, {R("avg(memory_usage_mb)")} as memory_avg,
  min(error_rate) as errors_min, max(error_rate) as errors_max, {R("avg(error_rate)")} as errors_avg from metrics_wide group by 1""")
def d6(spark, p):
    return _r(agg.summarize_metrics(t.metrics_wide(spark, p)), "cpu_avg", "memory_avg", "errors_avg")


@query("d7_incident_counts", "select type, severity, count(*) as incidents from incidents group by 1, 2")
def d7(spark, p):
    return agg.incident_counts(t.incidents(spark, p), ["type", "severity"])


@query("d8_severity_rollup", """select affected_service, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high,
  count(*) filter (severity not in ('CRITICAL', 'HIGH')) as other from incidents group by 1""")
def d8(spark, p):
    return agg.severity_rollup(t.incidents(spark, p), ["affected_service"])


@query("d9_remediation_summary", f"""select target, count(*) as total, count(*) filter (success) as successful, count(*) filter (not success) as failed,
  {R("100.0*count(*) filter (success)/count(*)")} as success_rate from remediation_actions group by 1""")
def d9(spark, p):
    return _r(agg.remediation_summary(t.remediation_actions(spark, p), ["target"]), "success_rate")


@query("d10_percentile_index", f"""with r as (select service_name, value, row_number() over (partition by service_name order by timestamp desc, id desc) as rn from incident_events),
s as (select service_name, value, row_number() over (partition by service_name order by value) - 1 as i, count(*) over (partition by service_name) as n from r where rn <= 100)
select service_name, {R("max(value) filter (i = cast(floor(n*0.5) as bigint))", 2)} as p50, {R("max(value) filter (i = cast(floor(n*0.95) as bigint))", 2)} as p95,
 {R("max(value) filter (i = cast(floor(n*0.99) as bigint))", 2)} as p99 from s group by 1""")
def d10(spark, p):
    return agg.percentile_index(t.incident_events(spark, p), "value", ["service_name"])


@query("d11_percentile_linear", f"""with r as (select service_name, value, row_number() over (partition by service_name order by timestamp desc, id desc) as rn from incident_events)
select service_name, {R("quantile_cont(value, 0.5)")} as p50, {R("quantile_cont(value, 0.95)")} as p95, {R("quantile_cont(value, 0.99)")} as p99, {R("avg(value)")} as avg from r where rn <= 1000 group by 1""")
def d11(spark, p):
    return _r(agg.percentile_linear(t.incident_events(spark, p), "value", ["service_name"]), "p50", "p95", "p99", "avg")


@query("d11_percentile_all", f"""select type, {R("quantile_cont(value, 0.5)")} as p50, {R("quantile_cont(value, 0.95)")} as p95, {R("quantile_cont(value, 0.99)")} as p99, {R("avg(value)")} as avg from incident_events group by 1""")
def d11_all(spark, p):
    return _r(agg.percentile_linear(t.incident_events(spark, p), "value", ["type"], last=None), "p50", "p95", "p99", "avg")


@query("d12_error_rate", f"select service_name, timestamp, {R('coalesce(error_count/nullif(request_count - 1, 0), 0)')} as rate from metrics_wide")
def d12(spark, p):
    m = t.metrics_wide(spark, p)
    return m.select("service_name", "timestamp", fixed(ratio("error_count", F.col("request_count") - 1)).alias("rate"))


_STATE = "case type when 'click' then 'active' when 'view' then 'idle' when 'error' then 'idle in transaction' else type end"


@query("d13_state_rollup", f"""with s as (select service_name, {_STATE} as state from incident_events)
select service_name, count(*) as total_connections, count(*) filter (state = 'active') as active, count(*) filter (state = 'idle') as idle,
 count(*) filter (state = 'idle in transaction') as idle_in_transaction, 5000 as max_connections, 5000 - count(*) as available, {R("count(*)*100.0/5000", 2)} as utilization_percent from s group by 1""")
def d13(spark, p):
    e = t.incident_events(spark, p)
    state = F.when(F.col("type") == "click", "active").when(F.col("type") == "view", "idle").when(F.col("type") == "error", "idle in transaction").otherwise(F.col("type"))
    return agg.state_rollup(e.withColumn("state", state), "state", 5000, ["service_name"])


@query("d14_guarded_percent", f"""select service_name, timestamp, case when request_count = 0 then 100 else {R("(request_count - error_count)*100.0/request_count", 2)} end as hit_ratio,
  case when error_count = 0 then 0 else {R("error_count*100.0/(error_count + request_count)", 2)} end as rollback_ratio from metrics_wide""")
def d14(spark, p):
    m = t.metrics_wide(spark, p)
    both = F.when(F.col("error_count") == 0, 0).otherwise(F.col("error_count") + F.col("request_count"))
    return m.select(
        "service_name", "timestamp",
        agg.guarded_percent(F.col("request_count") - F.col("error_count"), "request_count", 100).alias("hit_ratio"),
        agg.guarded_percent("error_count", both, 0).alias("rollback_ratio"),
    )


_TP, _FP, _TN, _FN = (f"count(*) filter ({c})" for c in ("label <> 'normal' and is_anomaly", "label = 'normal' and is_anomaly", "label = 'normal' and not is_anomaly", "label <> 'normal' and not is_anomaly"))


@query("d15_classification_report", f"""with c as (select {_TP} as tp, {_FP} as fp, {_TN} as tn, {_FN} as fn, count(*) as n from scores),
 d as (select *, tp/(tp+fp+1e-6) as pr, tp/(tp+fn+1e-6) as re from c)
select tp as true_positives, fp as false_positives, tn as true_negatives, fn as false_negatives, n as total_samples, tp+fn as total_anomalies,
 {R("pr")} as precision, {R("re")} as recall, {R("2*pr*re/(pr+re+1e-6)")} as f1_score, {R("(tp+tn)/n")} as accuracy from d""")
def d15(spark, p):
    rep = agg.classification_report(t.scores(spark, p), F.col("label") != "normal", F.col("is_anomaly"))
    return _r(rep, "precision", "recall", "f1_score", "accuracy")


@query("d16_label_distribution", f"""select label, count(*) as rows, {R("count(*)/(select count(*) from scores)")} as share from scores group by 1""")
def d16(spark, p):
    return _r(agg.label_distribution(t.scores(spark, p)), "share")


@query("d17_fit_errors", f"""select service, metric_name, count(*) as samples, {R("sqrt(avg((predicted_value-actual)*(predicted_value-actual)))")} as rmse, {R("avg(abs(predicted_value-actual))")} as mae,
 {R("avg(actual)")} as mean_value, {R("stddev_samp(actual)")} as std_value from forecasts where predicted_value is not null and actual is not null group by 1, 2""")
def d17(spark, p):
    return _r(agg.fit_errors(t.forecasts(spark, p), keys=["service", "metric_name"]), "rmse", "mae", "mean_value", "std_value")


@query("d18_evaluate_anomalies", f"""with m as (select exists (select 1 from incident_events i where i.type = 'error' and i.timestamp between s.timestamp - interval 10 minute and s.timestamp + interval 10 minute) as hit
 from scores s where is_anomaly and s.timestamp > timestamp '2024-01-31' - interval 480 hour)
select count(*) as total_predictions, count(*) filter (hit) as true_positives, {R("count(*) filter (hit)/count(*)")} as precision from m""")
def d18(spark, p):
    out = agg.evaluate_model("anomaly_detector", sc=t.scores(spark, p), inc=_event_incidents(spark, p), as_of=EV_NOW, hours=480)
    return _r(out, "precision")


@query("d18_evaluate_anomalies_fanout", f"""with m as (select s.id, i.id as hit from scores s left join incident_events i on i.type = 'error'
   and i.timestamp between s.timestamp - interval 10 minute and s.timestamp + interval 10 minute where is_anomaly)
select count(*) as total, count(hit) as hits, {R("count(hit)/count(*)")} as rate from m""")
def d18_fanout(spark, p):
    inc = _event_incidents(spark, p).filter(F.col("type") == "ml_anomaly")
    left = t.scores(spark, p).filter("is_anomaly").select("id", "timestamp")
    return _r(agg.evaluate_fanout(jn.count_matches(left, inc, [], ["id"], 600, 600)), "rate")


@query("d18_evaluate_predictions", f"""with m as (select exists (select 1 from incident_events i where i.timestamp between s.timestamp and s.timestamp + interval 1 hour) as hit
 from predictions s where risk_level <> 'low')
select count(*) as predictions, count(*) filter (hit) as correct, {R("count(*) filter (hit)/count(*)")} as accuracy from m""")
def d18_pred(spark, p):
    return _r(agg.evaluate_model("failure_predictor", pr=t.predictions(spark, p), inc=t.incident_events(spark, p), as_of=EV_NOW, hours=9000), "accuracy")


@query("d18_evaluate_forecasts", f"""select {R("coalesce(avg(abs(f.predicted_value - m.value)), 0)")} as mae, count(*) as comparisons from forecasts f join metrics_long m
 on m.service = f.service and m.metric_name = f.metric_name and m.timestamp between f.predicted_timestamp - interval 5 minute and f.predicted_timestamp + interval 5 minute""")
def d18_fc(spark, p):
    out = agg.evaluate_model("forecaster", fc=t.forecasts(spark, p).drop("actual"), actual=t.metrics_long(spark, p), as_of=EV_NOW, hours=9000)
    return _r(out, "mae")


@query("d19_score_stats", f"""select label, count(*) as samples, {R("avg(anomaly_score)")} as score_mean, {R("stddev_pop(anomaly_score)")} as score_std, min(anomaly_score) as score_min,
 max(anomaly_score) as score_max, count(*) filter (is_anomaly) as anomalies_detected, count(*) filter (not is_anomaly) as normal_detected from scores group by 1""")
def d19(spark, p):
    return _r(agg.score_stats(t.scores(spark, p), ["label"]), "score_mean", "score_std")


@query("d20_mttr", f"""select type, severity, count(*) as incidents, {R("avg(resolution_time_seconds) filter (status = 'RESOLVED')")} as mttr_seconds from incidents group by 1, 2""")
def d20(spark, p):
    return _r(agg.mttr(t.incidents(spark, p), ["type", "severity"]), "mttr_seconds")


@query("d21_histogram", f"""with h as (select service, timestamp, le, cum from hist_buckets union all
 select service, date_trunc('day', timestamp), 'inf'::double, count(*) from (select concat('svc_', user_id % 4) as service, ts as timestamp from events) e group by 1, 2),
 s as (select concat('svc_', user_id % 4) as service, date_trunc('day', ts) as timestamp, count(*) as n, {R("sum(value)/100")} as total from events group by 1, 2)
select h.service, h.timestamp, s.n as count, s.total as sum, case when h.le = 'inf'::double then '+Inf' else cast(h.le as varchar) end as le, cast(h.cum as bigint) as cum from h join s using (service, timestamp)""")
def d21(spark, p):
    from fleetlens.functions.dates import day_start

    e = t.incident_events(spark, p).select(F.col("service_name").alias("service"), day_start("timestamp").alias("timestamp"), (F.col("value") / 100).alias("v"))
    h = agg.histogram(e, "v", t.REQUEST_BOUNDS, ["service", "timestamp"])
    return _r(h, "sum").withColumn("le", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")))


@query("d22_histogram_quantile", f"""with b as (select service, timestamp, le, cum, lag(le, 1, 0) over w as lo, lag(cum, 1, 0) over w as below, max(cum) over (partition by service, timestamp) as total
  from hist_buckets window w as (partition by service, timestamp order by le)),
 f as (select *, row_number() over (partition by service, timestamp order by le) as rn from b where cum >= 0.95*total)
select service, timestamp, {R("lo + (le - lo)*(0.95*total - below)/nullif(cum - below, 0)")} as quantile from f where rn = 1""")
def d22(spark, p):
    return _r(agg.histogram_quantile(t.hist_buckets(spark, p), 0.95, ["service", "timestamp"]), "quantile")


@query("d23_vector_agg", f"""select service, status, {R("avg(value)")} as value from counters group by 1, 2""")
def d23(spark, p):
    c = _labelled(t.counters(spark, p), "service", "status")
    return _r(agg.vector_agg(c.select("labels", "value"), "avg", ["service", "status"]), "value")


@query("d24_vector_ratio", f"""select a.service, {R("100.0*a.v/b.v")} as value from (select service, sum(value) as v from counters where status = '500' group by 1) a
 join (select service, sum(value) as v from counters group by 1) b using (service)""")
def d24(spark, p):
    c = _labelled(t.counters(spark, p), "service", "status").select("labels", "value")
    bad = agg.vector_agg(flt.match_labels(c, [("status", "=~", "5..")]), "sum", ["service"])
    return _r(agg.vector_ratio(bad, agg.vector_agg(c, "sum", ["service"]), ["service"], 100), "value")


# ---- F and G --------------------------------------------------------------------------------------

@query("f1_page", "select id, timestamp, type from incidents order by timestamp desc, id limit 25 offset 100")
def f1(spark, p):
    return flt.page(t.incidents(spark, p).select("id", "timestamp", "type"), [F.desc("timestamp"), F.col("id")], 25, 100)


@query("f1_page_by_key", """select id, timestamp, status from (select *, row_number() over (order by timestamp desc, id desc) as rn from incidents) q where rn between 1001 and 1050""")
def f1_keys(spark, p):
    """The page behind the thousandth incident, read by its key."""
    inc, keys = t.incidents(spark, p), [("timestamp", True), ("id", True)]
    before = flt.page_index(inc, keys, 999).filter("page = 1").first()  # the row of rank 1,000
    return flt.page_after(inc, keys, 50, before[1:] if before else None).select("id", "timestamp", "status")


@query("f1_page_index", "select (rn - 1) // 40 as page, timestamp, id from (select *, row_number() over (order by timestamp desc, id) as rn from remediation_actions) q where (rn - 1) % 40 = 0")
def f1_index(spark, p):
    return flt.page_index(t.remediation_actions(spark, p), [("timestamp", True), ("id", False)], 40)


@query("g1_union_labelled", """select timestamp, service_name, cpu_usage_percent, 'busy' as label from metrics_wide where cpu_usage_percent > 80
union all select timestamp, service_name, null, 'failing' from metrics_wide where error_rate > 0.2""")
def g1(spark, p):
    m = t.metrics_wide(spark, p)
    sets = {
        "busy": m.filter("cpu_usage_percent > 80").select("timestamp", "service_name", "cpu_usage_percent"),
        "failing": m.filter("error_rate > 0.2").select("timestamp", "service_name"),
    }
    return setops.union_labelled(sets)


@query("g3_align_columns", "select service_name, cpu_usage_percent, 0.0::double as disk_usage_percent from metrics_wide")
def g3(spark, p):
    return setops.align_columns(t.metrics_wide(spark, p), ["service_name", "cpu_usage_percent", "disk_usage_percent"])
