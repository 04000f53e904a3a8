"""Registration of queries with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def R(expr: str, digits: int = 4) -> str:
    """SQL text of `functions.numeric.fixed`."""
    s = 10**digits
    return f"(floor(({expr})*{s}.0::double+0.500001::double)/{s}.0::double)"


_SVC4 = "concat('svc_', cast(user_id % 4 as varchar))"

# The views of sources.tables, written independently in SQL.
VIEWS = {
    "metrics_wide": f"""select {_SVC4} as service_name, date_trunc('hour', ts) as timestamp,
  count(*) as request_count, cast(sum(case when event_type='error' then 1 else 0 end) as bigint) as error_count,
  {R("cast(sum(case when event_type='error' then 1 else 0 end) as double)/count(*)")} as error_rate,
  {R("least(100.0, avg(value)*2)")} as cpu_usage_percent, {R("sum(value)*10")} as memory_usage_mb,
  {R("least(100.0, max(value))")} as memory_usage_percent,
  {R("quantile_cont(value, 0.5)")} as response_time_p50, {R("quantile_cont(value, 0.95)*10")} as response_time_p95
from events group by 1, 2""",
    "metrics_long": f"""select {_SVC4} as service, date_trunc('hour', ts) as timestamp,
  case event_type when 'error' then 'error_rate' when 'click' then 'cpu_usage' when 'view' then 'memory_usage'
    when 'purchase' then 'response_time' else 'disk_usage' end as metric_name, value, event_id from events""",
    "incidents": """select o_orderkey as id, o_orderdate as timestamp,
  case o_orderkey % 6 when 0 then 'health_check_failed' when 1 then 'high_error_rate' when 2 then 'cpu_spike'
    when 3 then 'high_response_time' when 4 then 'ml_anomaly' else 'predicted_breach' end as type,
  case when o_orderpriority in ('1-URGENT','2-HIGH') then 'CRITICAL' when o_orderpriority='3-MEDIUM' then 'WARNING' else 'INFO' end as severity,
  case o_orderstatus when 'O' then 'ACTIVE' when 'F' then 'RESOLVED' else 'ESCALATED' end as status,
  concat('svc_', cast(o_custkey % 10 as varchar)) as affected_service,
  cast(o_custkey % 3600 as int) as resolution_time_seconds from orders""",
    "remediation_actions": """select l_orderkey*10+l_linenumber as id, l_orderkey as incident_id, l_shipdate as timestamp,
  case l_linenumber % 3 when 0 then 'restart_container' when 1 then 'start_replica' else 'stop_replica' end as action_type,
  concat('svc_', cast(l_suppkey % 10 as varchar)) as target, l_returnflag <> 'R' as success,
  cast(l_quantity*100 as int) as execution_time_ms from lineitem""",
    "incident_events": f"""select event_id as id, ts as timestamp, event_type as type, {_SVC4} as service_name, value from events""",
    "failures": "select * from incident_events where type = 'error'",
    "counters": f"""select {_SVC4} as service, event_type,
  case when event_type='error' then '500' else '200' end as status, ts as timestamp, event_id,
  (count(*) over (partition by user_id % 4, event_type order by ts, event_id)) % 50 as value from events""",
    "hist_buckets": f"""select {_SVC4} as service, date_trunc('day', ts) as timestamp, b.le,
  cast(sum(case when value/100 <= b.le then 1 else 0 end) as bigint) as cum
from events cross join (select cast(x as double) as le
  from (values (0.01),(0.05),(0.1),(0.5),(1.0),(2.5),(5.0),(10.0)) as v(x)) b group by 1, 2, 3""",
    "logs": """select ts as timestamp, event_id, case when user_id % 2 = 0 then 'app' else 'bot' end as service,
  concat(case when event_type='error' then 'ERROR' else 'INFO' end, ' ', event_type, ' ', props) as line, props from events""",
    "scores": f"""select event_id as id, ts as timestamp, {R("0.1 - value/500", 6)} as anomaly_score, value > 50 as is_anomaly,
  case when event_type='error' then 'anomaly' else 'normal' end as label from events""",
    "predictions": f"""select event_id as id, ts as timestamp, {R("least(1.0, value/100)")} as failure_probability,
  case when value/100 >= 0.7 then 'high' when value/100 >= 0.4 then 'medium' else 'low' end as risk_level from events""",
    "forecasts": f"""select service, metric_name, timestamp as predicted_timestamp,
  lag(v, 24) over (partition by service, metric_name order by timestamp) as predicted_value, v as actual
from (select service, metric_name, timestamp, {R("avg(value)")} as v from metrics_long group by 1, 2, 3) q""",
    "registry": """select o_orderkey as id,
  case o_custkey % 3 when 0 then 'anomaly_detector' when 1 then 'failure_predictor' else 'forecaster' end as model_name,
  case o_custkey % 3 when 0 then 'isolation_forest' when 1 then 'boosted_trees' else 'seasonal_trend' end as model_type,
  o_orderdate as trained_at, 0.5::double + (o_orderkey % 50)/100.0::double as accuracy, o_totalprice > 100000 as is_active from orders""",
    "config_rows": """select concat('cfg_', c_custkey) as key, case when c_custkey % 11 = 0 then 'not json' else
  concat('{"thresholds": {"cpu_percent": ', c_custkey % 40 + 50, ', "error_rate": 0.', c_custkey % 9 + 1, '}',
    case c_custkey % 3 when 0 then concat(', "circuit_breaker": {"failure_threshold": ', c_custkey % 5 + 1, '}')
      when 1 then concat(', "remediation": {"max_restarts_per_5min": ', c_custkey % 7 + 1, '}') else '' end, '}') end as value,
  timestamp '1995-01-01' as updated_at, 'system' as updated_by from customer""",
    "config_updates": """select concat('cfg_', o_custkey + o_orderkey % 2 * 1000) as key,
  concat('{"limit": ', o_orderkey, '}') as value, o_orderdate as updated_at, o_orderkey as seq from orders""",
}


def with_views(sql: str) -> str:
    """Put the views a statement names in front of it, each after the views it needs itself."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if v not in wanted and re.search(rf"\b{v}\b", text):
                need(VIEWS[v])
                if v not in wanted:
                    wanted.append(v)

    need(sql)
    if not wanted:
        return sql
    heads = ",\n".join(f"{v} as ({VIEWS[v]})" for v in wanted)
    recursive = "recursive " if sql.lstrip().lower().startswith("with recursive") else ""
    body = re.sub(r"^\s*with\s+(recursive\s+)?", "", sql, flags=re.I) if sql.lstrip().lower().startswith("with") else None
    return f"with {recursive}{heads},\n{body}" if body is not None else f"with {heads}\n{sql}"


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its twin over the base tables and the views above."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return add
