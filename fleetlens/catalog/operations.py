"""Queries for rules, stateful replays, text and retention (inventory groups H, I, J, L and M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import R, query
from fleetlens.functions import display
from fleetlens.functions.numeric import fixed
from fleetlens.operators import retention as ret
from fleetlens.operators import rules, stateful, textops
from fleetlens.sources import tables as t

INC_NOW = "2001-08-01 00:00:00"
EV_NOW = "2024-01-31 00:00:00"

_DETECT = """select service_name, timestamp, 'high_error_rate' as type, case when error_rate > 0.2*3 then 'CRITICAL' else 'WARNING' end as severity from metrics_wide where error_rate > 0.2
union all select service_name, timestamp, 'cpu_spike', case when cpu_usage_percent > 80*1.2 then 'CRITICAL' else 'WARNING' end from metrics_wide where cpu_usage_percent > 80
union all select service_name, timestamp, 'high_response_time', case when response_time_p95 > 1000 then 'CRITICAL' else 'WARNING' end from metrics_wide where response_time_p95 > 500"""

# Hours are at least 3600 s apart, so a window of 7200 s lets through the first of any two in a row.
_CHAIN = """with recursive d as ({rows}), k as (
 select service_name, type, min(timestamp) as ts from d group by 1, 2
 union all select k.service_name, k.type, (select min(d.timestamp) from d where d.service_name = k.service_name and d.type = k.type and d.timestamp >= k.ts + interval 7200 second) from k where k.ts is not null)
"""


@query("flagship", _CHAIN.format(rows=_DETECT) + """select d.type, d.severity, case when d.type is not null then 'restart_container' end as action_type, count(*) as incidents
from d join k on k.service_name = d.service_name and k.type = d.type and k.ts = d.timestamp group by 1, 2, 3""")
def flagship(spark, p):
    """Metric histories to incidents, repeated ones dropped, with the action chosen for each."""
    found = rules.detect_all(t.metrics_wide(spark, p))
    fresh = stateful.dedupe(found, ["service_name", "type"], window_s=7200, ties=("severity",))
    acts = rules.choose_action(fresh)
    return acts.groupBy("type", "severity", "action_type").agg(F.count("*").alias("incidents"))


def _documents(spark, p):
    """Health documents from the hourly metrics; an hour with a single request counts as a failed poll."""
    m = t.metrics_wide(spark, p)
    doc = F.struct(
        F.struct(
            F.col("request_count").alias("total_requests"), F.col("error_count").alias("total_errors"), "error_rate",
            "cpu_usage_percent", F.col("response_time_p50").alias("response_time_p50_ms"), F.col("response_time_p95").alias("response_time_p95_ms"),
        ).alias("metrics"),
        F.struct((F.col("error_count") >= 3).alias("cpu_spike")).alias("flags"),
    )
    return m.select("service_name", "timestamp", F.when(F.col("request_count") > 1, doc).alias("doc"))


@query("i1_i4_health_documents", """with m as (select *, request_count > 1 as up from metrics_wide)
select service_name, timestamp, 'health_check_failed' as type, 'CRITICAL' as severity from m where not up
union all select service_name, timestamp, 'high_error_rate', case when error_rate > 0.2*3 then 'CRITICAL' else 'WARNING' end from m where up and error_rate > 0.2
union all select service_name, timestamp, 'cpu_spike', case when cpu_usage_percent > 80*1.2 then 'CRITICAL' else 'WARNING' end from m where up and (cpu_usage_percent > 80 or error_count >= 3)
union all select service_name, timestamp, 'high_response_time', case when response_time_p95 > 1000 then 'CRITICAL' else 'WARNING' end from m where up and response_time_p95 > 500""")
def i1(spark, p):
    return rules.detect_all(rules.health_frame(_documents(spark, p))).drop("details")


def _one(spark, p, detector, *fields):
    m = t.metrics_wide(spark, p)
    d = m.select("service_name", "timestamp", detector(m).alias("i")).filter(F.col("i").isNotNull())
    extra = [fixed(F.get_json_object("i.details", f"$.{f}").cast("double")).alias(f) for f in fields]
    return d.select("service_name", "timestamp", "i.severity", *extra)


@query("i2_high_error_rate", f"select service_name, timestamp, case when error_rate > 0.2*3 then 'CRITICAL' else 'WARNING' end as severity, {R('error_rate')} as error_rate, error_count::double as total_errors from metrics_wide where error_rate > 0.2")
def i2(spark, p):
    return _one(spark, p, rules.high_error_rate, "error_rate", "total_errors")


@query("i3_cpu_spike", f"select service_name, timestamp, case when cpu_usage_percent > 80*1.2 then 'CRITICAL' else 'WARNING' end as severity, {R('cpu_usage_percent')} as cpu_usage_percent from metrics_wide where cpu_usage_percent > 80")
def i3(spark, p):
    return _one(spark, p, rules.cpu_spike, "cpu_usage_percent")


@query("i4_high_response_time", f"select service_name, timestamp, case when response_time_p95 > 1000 then 'CRITICAL' else 'WARNING' end as severity, {R('response_time_p50')} as p50_ms from metrics_wide where response_time_p95 > 500")
def i4(spark, p):
    return _one(spark, p, rules.high_response_time, "p50_ms")


_SEV = R("greatest(0.0, least(100.0, 50 - 20*(anomaly_score - 0.02)/0.05))")


@query("i5_ml_anomaly", f"select id, timestamp, case when sev >= 85 then 'CRITICAL' else 'WARNING' end as severity from (select *, {_SEV} as sev from scores) q where is_anomaly and sev >= 70")
def i5(spark, p):
    raw = F.lit(50.0) - F.lit(20.0) * (F.col("anomaly_score") - 0.02) / 0.05
    s = t.scores(spark, p).withColumn("anomaly_severity", fixed(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))))
    d = s.select("id", "timestamp", rules.ml_anomaly(s).alias("i")).filter(F.col("i").isNotNull())
    return d.select("id", "timestamp", "i.severity")


@query("i8_choose_action", """select type, coalesce(action_type, 'none') as action_type, count(*) as n from
 (select type, case when type in ('health_check_failed', 'high_error_rate', 'cpu_spike', 'high_response_time') then 'restart_container' end as action_type from incidents) q group by 1, 2""")
def i8(spark, p):
    inc = t.incidents(spark, p).withColumn("details", F.lit("{}"))
    acts = rules.choose_action(inc, "affected_service")
    return acts.groupBy("type", F.coalesce("action_type", F.lit("none")).alias("action_type")).agg(F.count("*").alias("n"))


@query("i8_action_reasons", f"""select service_name, timestamp, 'High error rate: ' || printf('%.2f', error_rate*100) || '% - restarting to recover' as reason from metrics_wide where error_rate > 0.2""")
def i8_reasons(spark, p):
    found = rules.detect_all(t.metrics_wide(spark, p)).filter(F.col("type") == "high_error_rate")
    return rules.choose_action(found).select("service_name", "timestamp", "reason")


@query("i9_health_verdict", f"""with h as (select service_name, timestamp, 20 - request_count as available, {R("request_count*100.0/20", 2)} as used,
  {R("(request_count - error_count)*100.0/request_count", 2)} as hit, {R("error_count*100.0/(error_count + request_count)", 2)} as back, case when memory_usage_percent > 90 then 1 else 0 end as dead from metrics_wide)
select service_name, timestamp, case when available < 10 or dead > 0 then 'critical' when used > 80 or hit < 95 or back > 5 then 'warning' else 'healthy' end as status,
 cast((available < 10)::int + (available >= 10 and used > 80)::int + (hit < 95)::int + (back > 5)::int + (dead > 0)::int as int) as issue_count from h""")
def i9(spark, p):
    m = t.metrics_wide(spark, p)
    rc, ec = F.col("request_count"), F.col("error_count")
    h = m.select(
        "service_name", "timestamp", (F.lit(20) - rc).alias("available"), fixed(rc * 100.0 / 20, 2).alias("utilization_percent"),
        fixed((rc - ec) * 100.0 / rc, 2).alias("cache_hit_ratio"), fixed(ec * 100.0 / (ec + rc), 2).alias("rollback_ratio"),
        F.when(F.col("memory_usage_percent") > 90, 1).otherwise(0).alias("deadlocks"),
    )
    return rules.health_verdict(h).select("service_name", "timestamp", "status", F.size("issues").alias("issue_count"))


@query("i12_risk_level", "select id, case when failure_probability >= 0.7 then 'high' when failure_probability >= 0.4 then 'medium' else 'low' end as risk from predictions")
def i12(spark, p):
    return t.predictions(spark, p).select("id", rules.risk_level("failure_probability").alias("risk"))


@query("i13_proactive_incidents", "select id, timestamp, 'predicted_failure' as type, case risk_level when 'high' then 'HIGH' else 'MEDIUM' end as severity from predictions where risk_level <> 'low'")
def i13(spark, p):
    return rules.proactive_incidents(t.predictions(spark, p)).select("id", "timestamp", "type", "severity")


# ---- J: stateful ----------------------------------------------------------------------------------

def _chain(source, keys, seconds):
    on = " and ".join(f"e.{k} = k.{k}" for k in keys)
    cols = ", ".join(keys)
    return f"""with recursive src as ({source}), k as (
 select {cols}, min(timestamp) as ts from src group by {cols}
 union all select {", ".join(f"k.{k}" for k in keys)}, (select min(e.timestamp) from src e where {on} and e.timestamp >= k.ts + interval {seconds} second) from k where k.ts is not null)
select min(e.id) as id, {", ".join(f"e.{k}" for k in keys)}, e.timestamp from src e join k on {on} and e.timestamp = k.ts group by {", ".join(f"e.{k}" for k in keys)}, e.timestamp"""


@query("j2_dedupe", _chain("select * from incident_events", ["type"], 600))
def j2(spark, p):
    return stateful.dedupe(t.incident_events(spark, p), ["type"], window_s=600).select("id", "type", "timestamp")


@query("j2_dedupe_by_service", _chain("select * from incident_events", ["service_name", "type"], 3600))
def j2_service(spark, p):
    out = stateful.dedupe(t.incident_events(spark, p), ["service_name", "type"], window_s=3600)
    return out.select("id", "service_name", "type", "timestamp")


@query("j3_dedupe_predictions", _chain("select * from predictions where risk_level <> 'low'", ["risk_level"], 600))
def j3(spark, p):
    return stateful.dedupe_predictions(t.predictions(spark, p)).select("id", "risk_level", "timestamp")


def _requests(spark, p):
    e = t.incident_events(spark, p)
    act = F.when(F.col("type").isin("error", "click"), "restart_container").otherwise("start_replica")
    return e.select("id", "timestamp", "service_name", act.alias("action_type"), (F.col("value") < 30).alias("success"))


# The breaker in SQL: one recursion step per request of a service. h1 and h2 are the times of the two
# kinds of actions that ran.
_BREAKER = """with recursive e as (select id, service_name, timestamp, epoch_us(timestamp) as t, type in ('error', 'click') as restart, value < 30 as ok,
  row_number() over (partition by service_name order by timestamp, id) as n from incident_events),
 k as (
 select service_name, cast(0 as bigint) as n, cast(null as bigint) as id, cast(null as timestamp) as timestamp, true as ok, cast(null as varchar) as why, 'CLOSED' as st, cast(null as bigint) as opened,
  cast(0 as bigint) as failures, cast([] as bigint[]) as h1, cast([] as bigint[]) as h2 from (select distinct service_name from e) q
 union all
 select service_name, n, id, timestamp, ok, why, case when why is not null then 'OPEN' when ok and st1 = 'HALF_OPEN' then 'CLOSED' else st1 end,
  case when why = 'limit' then t when why is null and ok and st1 = 'HALF_OPEN' then null else opened end,
  case when why = 'limit' then len(h) when why = 'cooldown' then failures when ok and st1 = 'HALF_OPEN' then 0 when not ok then failures + 1 else failures end,
  case when why = 'cooldown' or not restart then h1 when why = 'limit' then h else list_append(h, t) end,
  case when why = 'cooldown' or restart then h2 when why = 'limit' then h else list_append(h, t) end
 from (select *, case when st = 'OPEN' and t - opened < 1200000000 then 'cooldown' when len(h) >= 3 then 'limit' end as why, case when st = 'OPEN' then 'HALF_OPEN' else st end as st1
  from (select e.service_name, e.n, e.id, e.timestamp, e.t, e.restart, e.ok, k.st, k.opened, k.failures, k.h1, k.h2, [x for x in case when e.restart then k.h1 else k.h2 end if x >= e.t - 3600000000] as h
   from k join e on e.service_name = k.service_name and e.n = k.n + 1) a) b)
"""


def _replayed(spark, p):
    return stateful.breaker_replay(_requests(spark, p), window_s=3600, cooldown_s=1200)


@query("j4_breaker_replay", _BREAKER + "select id, service_name, why is null as allowed, why as denied_by, st as breaker_state, failures as failure_count, make_timestamp(opened) as opened_at from k where n > 0")
def j4(spark, p):
    return _replayed(spark, p).select("id", "service_name", "allowed", "denied_by", "breaker_state", "failure_count", "opened_at")


@query("j5_breaker_states", _BREAKER + """, l as (select service_name, st, failures, opened, row_number() over (partition by service_name order by n desc) as rn from k where n > 0 and timestamp <= timestamp '2024-01-15 12:00:00'),
 a as (select service_name, max(timestamp) as last_attempt from k where n > 0 and why is null and timestamp <= timestamp '2024-01-15 12:00:00' group by 1)
select l.service_name, st as breaker_state, failures as failure_count, make_timestamp(opened) as opened_at, last_attempt,
 case when opened is not null then greatest(0, cast(trunc(1200 - (epoch_us(timestamp '2024-01-15 12:00:00') - opened)/1000000.0) as int)) end as cooldown_remaining_seconds from l join a using (service_name) where rn = 1""")
def j5(spark, p):
    return stateful.breaker_states(_replayed(spark, p), "2024-01-15 12:00:00", 1200)


@query("j6_escalations", _BREAKER + "select service_name, case when why is null then 'failed' else 'blocked' end as kind, count(*) as n from k where n > 0 and (why is not null or not ok) group by 1, 2")
def j6(spark, p):
    esc = stateful.escalations(_replayed(spark, p), window_s=3600, cooldown_s=1200)
    return esc.filter(F.col("reason").isNotNull()).groupBy("service_name", "kind").agg(F.count("*").alias("n"))


# ---- H: scalar helpers ----------------------------------------------------------------------------

@query("h_display", """select c_custkey, case when c_custkey % 7200 >= 3600 then concat(c_custkey % 7200 // 3600, 'h ', c_custkey % 7200 % 3600 // 60, 'm ', c_custkey % 60, 's')
   when c_custkey % 7200 >= 60 then concat(c_custkey % 7200 // 60, 'm ', c_custkey % 60, 's') else concat(c_custkey % 7200, 's') end as lasted,
  case when length(c_name) <= 12 then c_name else substr(c_name, 1, 12) || '...' end as short,
  format('{:,}', c_custkey * 1234) as grouped, case when c_custkey = 0 then '0 Bytes' when c_custkey * 1024 < 1048576 then c_custkey || ' KB' else '' end as size from customer""")
def h_display(spark, p):
    k = F.col("c_custkey")
    kb = display.byte_size(k * 1024)
    return t.table(spark, p, "customer").select(
        "c_custkey", display.duration(k % 7200).alias("lasted"), display.shorten("c_name", 12).alias("short"),
        display.thousands(k * 1234).alias("grouped"), F.when(k * 1024 < 1048576, kb).otherwise("").alias("size"),
    )


# ---- L: text --------------------------------------------------------------------------------------

@query("l1_context_pack", """with i as (select affected_service as service, 'ID' || id || ': ' || type || ' ' || severity || ' ' || status || ' at ' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') as line,
  row_number() over (partition by affected_service order by timestamp desc, id desc) as rn from incidents)
select service, count(*) filter (rn <= 10) as incidents_total, string_agg(line, chr(10) order by rn) filter (rn <= 5) as incidents_text from i group by 1""")
def l1(spark, p):
    out = textops.context_pack(t.incidents(spark, p), t.remediation_actions(spark, p), as_of="2001-08-01T00:00:00")
    return out.select("service", "incidents_total", "incidents_text")


@query("l2_incident_prompts", """select id, 'Analyze this incident and answer in JSON.' || chr(10) || chr(10) || 'INCIDENT TYPE: ' || type || chr(10) || 'SEVERITY: ' || severity || chr(10) ||
 'DETAILS: {"affected_service":"' || affected_service || '","resolution_time_seconds":' || resolution_time_seconds || '}' as prompt from incidents""")
def l2(spark, p):
    return textops.incident_prompts(t.incidents(spark, p), ["affected_service", "resolution_time_seconds"]).select("id", "prompt")


def _answers(spark, p):
    """Answers as a text model gives them: prose around JSON, broken JSON, or no JSON."""
    k = F.col("event_id")
    body = F.concat(F.lit('{"root_cause": "'), F.col("event_type"), F.lit('", "confidence": "high", "explanation": "k", "immediate_actions": ["a'), k.cast("string"),
                    F.lit('", "b"], "preventive_measures": ["c", "d"], "monitoring_adjustments": ["e", "f"]}'))
    text = F.when(k % 3 == 0, F.concat(F.lit("Here it is: "), body, F.lit(" done"))).when(k % 3 == 1, F.concat(F.lit("{broken "), "props")).otherwise(F.concat(F.lit("no answer "), k.cast("string")))
    return t.table(spark, p, "events").select(k.alias("id"), text.alias("response"))


@query("l3_parse_responses", """select event_id as id, case event_id % 3 when 0 then event_type when 1 then 'Response parsing failed' else 'Unable to parse structured response' end as root_cause,
 case event_id % 3 when 0 then 'k' when 1 then '{broken ' || props else 'no answer ' || event_id end as explanation, case event_id % 3 when 0 then 'high' else 'low' end as confidence from events""")
def l3(spark, p):
    return textops.parse_responses(_answers(spark, p)).select("id", "root_cause", "explanation", "confidence")


@query("l4_top_suggestions", """select event_id as id, case when event_id % 3 = 0 then 'a' || event_id || '|b|c|d|e' else '' end as suggestions from events""")
def l4(spark, p):
    out = textops.top_suggestions(textops.parse_responses(_answers(spark, p)))
    return out.select("id", F.array_join("top_suggestions", "|").alias("suggestions"))


@query("l5_fallback_reports", """with a as (select incident_id, row_number() over (partition by incident_id order by timestamp, action_type, target, success, id, execution_time_ms) as line_no, action_type, success from remediation_actions)
select incident_id, line_no, line_no || '. ' || action_type || ' - ' || case when success then 'Success' else 'Failed' end as line from a
union all select id, 0, 'Incident Report' || chr(10) || chr(10) || 'Type: ' || type || chr(10) || 'Severity: ' || severity || chr(10) || 'Time: ' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || chr(10) || chr(10) || 'Description:' || chr(10) || '{}' || chr(10) || chr(10) || 'Remediation Actions Taken:' from incidents""")
def l5(spark, p):
    return textops.fallback_reports(t.incidents(spark, p), t.remediation_actions(spark, p))


@query("l6_notifications", """select id, case when value > 50 then 'CRITICAL' else 'WARNING' end as message_severity,
 case when value > 50 then ':red_circle: *CRITICAL* - ' else ':warning: *WARNING* - ' end || 'Incident detected on `' || service_name || '`: **' || type || '** (' || case when value > 50 then 'CRITICAL' else 'WARNING' end || ')' as text from incident_events""")
def l6(spark, p):
    e = t.incident_events(spark, p).withColumnRenamed("service_name", "service")
    e = e.withColumns({"kind": F.lit("detected"), "severity": F.when(F.col("value") > 50, "CRITICAL").otherwise("WARNING")})
    return textops.notification_text(e).select("id", "message_severity", "text")


# ---- M: retention ---------------------------------------------------------------------------------

@query("m1_retain_actions", "select id, timestamp from incident_events where timestamp >= timestamp '2024-01-31' - interval 24 hour")
def m1(spark, p):
    return ret.retain(t.incident_events(spark, p), "timestamp", EV_NOW, 24).select("id", "timestamp")


@query("m2_retain_metrics", "select count(*) filter (timestamp >= timestamp '2024-01-31' - interval 10 day) as kept, count(*) filter (timestamp < timestamp '2024-01-31' - interval 10 day) as deleted from metrics_wide")
def m2(spark, p):
    kept, gone = ret.retain_metrics(t.metrics_wide(spark, p), EV_NOW, 10)
    both = kept.agg(F.count("*").alias("kept")).unionByName(gone, allowMissingColumns=True)
    return both.agg(F.max("kept").alias("kept"), F.max("deleted").alias("deleted"))


@query("m3_retain_counts", """with old as (select id from incidents where timestamp < timestamp '2001-08-01' - interval 180 day)
select 'incidents' as kind, count(*) as n from old union all
select 'remediation_actions', count(*) from remediation_actions where incident_id not in (select id from old) and timestamp < timestamp '2001-08-01' - interval 180 day""")
def m3_counts(spark, p):
    return ret.retain_incidents(t.incidents(spark, p), t.remediation_actions(spark, p), INC_NOW)[2]


@query("m3_retain_incidents", """with old as (select id from incidents where timestamp < timestamp '2001-08-01' - interval 180 day)
select a.* from remediation_actions a where incident_id not in (select id from old) and timestamp >= timestamp '2001-08-01' - interval 180 day""")
def m3(spark, p):
    return ret.retain_incidents(t.incidents(spark, p), t.remediation_actions(spark, p), INC_NOW)[1]


@query("m4_stamp", "select key, timestamp '2001-08-01' as updated_at from config_rows")
def m4(spark, p):
    return ret.stamp(t.config_rows(spark, p), INC_NOW).select("key", "updated_at")


@query("m5_retain_logs", "select event_id, line from logs where timestamp >= timestamp '2024-01-31' - interval 168 hour")
def m5(spark, p):
    return ret.retain(t.logs(spark, p), "timestamp", EV_NOW, 168).select("event_id", "line")


