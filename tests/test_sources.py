"""Readers, writers and the statement-like operators, on files and hand cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import aggregates as agg
from fleetlens.operators import filters as flt
from fleetlens.operators import joins as jn
from fleetlens.operators import retention as ret
from fleetlens.operators import rules, textops
from fleetlens.functions import display
from fleetlens.schemas import canonical, to_long, to_wide
from fleetlens.sources import ingest
from fleetlens.sources import partitions as parts
from fleetlens.sources import tables as t

T0 = datetime(2024, 1, 1, 12)


def ago(**kw):
    return T0 - timedelta(**kw)


@pytest.fixture(scope="module")
def seed(spark):
    """Four incidents and five actions as a fresh installation has them."""
    inc = spark.createDataFrame(
        [
            (1, ago(hours=2), "health_check_failed", "CRITICAL", "RESOLVED", 45), (2, ago(hours=1), "high_error_rate", "WARNING", "RESOLVED", 120),
            (3, ago(minutes=30), "cpu_spike", "WARNING", "RESOLVED", 60), (4, ago(minutes=10), "high_response_time", "INFO", "RESOLVED", 30),
            (5, ago(hours=30), "cpu_spike", "INFO", "ACTIVE", None),
        ],
        "id long, timestamp timestamp_ntz, type string, severity string, status string, resolution_time_seconds int",
    ).withColumn("affected_service", F.lit("web"))
    act = spark.createDataFrame(
        [(i + 1, inc_id, ago(minutes=60 - i), "restart_container", "web", True, ms) for i, (inc_id, ms) in enumerate([(1, 3456), (2, 5234), (2, 3122), (3, 4987), (4, 3345)])],
        "id long, incident_id long, timestamp timestamp_ntz, action_type string, target string, success boolean, execution_time_ms int",
    )
    return inc, act


def test_seed_views(seed):
    inc, act = seed
    s = agg.remediation_stats(act, T0).first()
    assert (s["total_attempts"], s["successful"], s["success_rate"], s["avg_execution_time_ms"]) == (5, 5, 100.0, 4028.8)
    got = {r["id"]: r["remediation_attempts"] for r in jn.recent_incidents(inc, act, T0).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1}
    detail = jn.incident_detail(inc, act, [2, 5]).collect()
    assert [(r["id"], r["action_type"]) for r in detail] == [(2, "restart_container")] * 2 + [(5, None)]
    solved = {r["id"]: r for r in ingest.resolve_incidents(inc, act, T0).collect()}
    assert solved[3]["resolution_time_seconds"] == round((ago(minutes=57) - ago(minutes=30)).total_seconds())
    assert solved[5]["status"] == "ACTIVE" and solved[5]["updated_at"] is None and solved[1]["updated_at"] == T0


def test_detector_edges(spark):
    m = spark.createDataFrame([("a", T0, 0.2, 80.0, 500.0), ("b", T0, 0.25, 80.1, 500.1), ("c", T0, 0.61, 96.1, 1000.5)], "service_name string, timestamp timestamp_ntz, error_rate double, cpu_usage_percent double, response_time_p95 double")
    got = {(r["service_name"], r["type"]): r["severity"] for r in rules.detect_all(m).collect()}
    kinds = ("high_error_rate", "cpu_spike", "high_response_time")
    assert got == {("b", k): "WARNING" for k in kinds} | {("c", k): "CRITICAL" for k in kinds}


def test_own_thresholds(spark):
    m = spark.createDataFrame([("a", T0, 0.15, 10.0)], "service_name string, timestamp timestamp_ntz, error_rate double, th_error_rate double")
    m = m.withColumn("th_error_rate", F.lit(0.1))
    assert rules.detect_all(m).first()["type"] == "high_error_rate"


def test_percentile_definitions(spark):
    df = spark.range(1, 101).select(F.lit("s").alias("k"), F.col("id").cast("double").alias("value"), F.col("id").alias("timestamp"), "id")
    a = agg.percentile_index(df, "value", ["k"]).first()
    b = agg.percentile_linear(df, "value", ["k"]).first()
    assert (a["p50"], a["p95"], a["p99"]) == (51.0, 96.0, 100.0) and (round(b["p95"], 4), round(b["avg"], 1)) == (95.05, 50.5)


def test_histogram_quantile_edges(spark):
    rows = [("in", 1.0, 10.0), ("in", 2.0, 20.0), ("in", float("inf"), 20.0), ("over", 1.0, 1.0), ("over", float("inf"), 100.0), ("none", 1.0, 0.0), ("none", float("inf"), 0.0)]
    q = {r["k"]: r["quantile"] for r in agg.histogram_quantile(spark.createDataFrame(rows, "k string, le double, cum double"), 0.75, ["k"]).collect()}
    assert q == {"in": 1.5, "over": 1.0, "none": None}


def test_append_and_expire(spark, small, tmp_path):
    path = str(tmp_path / "m")
    m = t.metrics_wide(spark, small)
    ingest.append_predictions("metrics", m, path, "1")
    ingest.append_predictions("metrics", m.limit(3), path, "2")
    assert spark.read.parquet(f"{path}/metrics").count() == m.count() + 3
    gone = ret.expire_days(spark, f"{path}/metrics", "2024-01-31 00:30:00", 10)
    left = parts.read_table(spark, f"{path}/metrics")
    assert left.agg(F.min("timestamp")).first()[0] >= datetime(2024, 1, 21, 0, 30) and left.count() == m.count() + 3 - gone
    ingest.append_metrics(m, str(tmp_path / "h"), "1")
    assert set(spark.read.parquet(str(tmp_path / "h")).columns) >= {"service_name", "date"}


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_export(spark, small, tmp_path, fmt):
    m, path = t.metrics_wide(spark, small), str(tmp_path / fmt)
    ingest.export_metrics(m, fmt, path, as_of="2024-01-31 00:00:00")
    back = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.json(path)
    assert back.count() == m.filter(F.col("timestamp") >= F.lit("2024-01-01").cast("timestamp_ntz")).count()
    with pytest.raises(ValueError):
        ingest.export_metrics(m, "xml", path, as_of="2024-01-31")


def test_save_training(spark, small, tmp_path):
    m = t.metrics_wide(spark, small).withColumn("label", F.lit("normal"))
    ingest.save_training(m, str(tmp_path / "csv"), str(tmp_path / "hist"), "1")
    assert "label" in spark.read.option("header", True).csv(str(tmp_path / "csv")).columns
    assert "label" not in spark.read.parquet(str(tmp_path / "hist")).columns


def test_read_logs_and_samples(spark, tmp_path):
    (tmp_path / "logs" / "web").mkdir(parents=True)
    (tmp_path / "logs" / "web" / "a.log").write_text("ERROR one\nINFO two\n")
    logs = ingest.read_logs(spark, str(tmp_path / "logs" / "*"), {"job": "containers"})
    assert [r["line"] for r in flt.line_filter(flt.match_labels(logs, [("container", "=", "web"), ("job", "=~", "con.*")]), "ERROR").collect()] == ["ERROR one"]
    text = '# HELP x y\n\nup 1\nreq_total{code="200",path="/a,b"} 3.5\nlat_bucket{le="+Inf"} +Inf\nbad{x="1"} nope\n'
    (tmp_path / "metrics.prom").write_text(text)
    got = {r["metric"]: (r["labels"], r["value"]) for r in ingest.read_samples(spark, str(tmp_path / "metrics.prom")).collect()}
    assert got["up"] == ({}, 1.0) and got["req_total"] == ({"code": "200", "path": "/a,b"}, 3.5)
    assert got["lat_bucket"][1] == float("inf") and got["bad"][1] is None


def test_alert_payload_defaults(spark):
    bad = spark.createDataFrame([(1, "not json"), (2, '{"alerts": [{"status": "firing", "labels": {}}]}'), (3, '{"alerts": []}')], "id int, payload string")
    rows = ingest.alerts_to_incidents(bad).collect()
    assert [(r["id"], r["type"], r["severity"], r["description"]) for r in rows] == [(2, "SYSTEM_ERROR", "WARNING", "Unknown")]


def test_log_incidents_repeatable(spark, small):
    e = t.incident_events(spark, small).withColumns({"severity": F.lit("INFO"), "details": F.struct(F.lit(1).alias("a"))})
    a, b = (ingest.incident_rows(e, ["id"]).select("id") for _ in range(2))
    assert a.exceptAll(b).isEmpty() and a.distinct().count() == e.count()


def test_guards(spark):
    with pytest.raises(ValueError):
        flt.require_rows(spark.range(9), 10)
    assert flt.require_rows(spark.range(10), 10).count() == 10
    assert flt.domain_ok(0.05, 6, 72) and not flt.domain_ok(0.2) and not flt.domain_ok(hours=25)


def test_shapes(spark):
    df = spark.createDataFrame([("a", T0, 1.0, 2.0)], "service string, timestamp timestamp_ntz, cpu_percent double, memory_mb double")
    wide = canonical(df)
    assert wide.columns == ["service_name", "timestamp", "cpu_usage_percent", "memory_usage_mb"]
    long = to_long(wide, ["cpu_usage_percent", "memory_usage_mb"], ["service_name", "timestamp"])
    assert long.count() == 2
    assert to_wide(long, ["cpu_usage_percent", "memory_usage_mb"], ["service_name", "timestamp"]).first()[2:] == (1.0, 2.0)


def test_health_verdict_and_display(spark):
    df = spark.createDataFrame([(5, 50.0, 99.0, 1.0, 0), (50, 85.5, 90.0, 6.0, 0), (50, 10.0, 99.0, 1.0, 0)], "available int, utilization_percent double, cache_hit_ratio double, rollback_ratio double, deadlocks int")
    out = rules.health_verdict(df).collect()
    assert [(r["status"], len(r["issues"])) for r in out] == [("critical", 1), ("warning", 3), ("healthy", 0)]
    assert out[1]["issues"][0]["message"] == "Connection pool 85.5% utilized"
    row = spark.range(1).select(
        display.duration(F.lit(3723)).alias("d"), display.byte_size(F.lit(1536)).alias("b"), display.byte_size(F.lit(0)).alias("z"),
        display.percent(F.lit(12.345)).alias("p"), display.title(F.lit("circuit_breaker")).alias("t"), display.shorten(F.lit("abcdef"), 3).alias("s"),
    ).first()
    assert tuple(row) == ("1h 2m 3s", "1.5 KB", "0 Bytes", "12.3%", "Circuit Breaker", "abc...")


def test_notifications(spark):
    rows = [("started", "restart", "web", "slow", None), ("succeeded", "restart", "web", None, None), ("failed", "restart", "web", None, "no"), ("breaker_opened", None, None, "many", None), ("escalation", None, None, "many", None)]
    df = spark.createDataFrame(rows, "kind string, action_type string, target string, reason string, error string").withColumns({"service": F.lit("web"), "execution_time_ms": F.lit(7)})
    got = {r["kind"]: (r["message_severity"], r["message"]) for r in textops.notification_text(df).collect()}
    assert got["started"] == ("INFO", "Starting remediation: `restart` on `web` - Reason: slow")
    assert got["succeeded"] == ("SUCCESS", "✅ Remediation successful: `restart` on `web` (completed in 7ms)")
    assert got["failed"] == ("CRITICAL", "❌ Remediation failed: `restart` on `web` - Error: no")
    assert got["breaker_opened"] == ("WARNING", "🚫 Circuit breaker OPENED for `web` - many")
    assert got["escalation"][1].startswith("🚨 ESCALATION REQUIRED for `web`")


def test_context_of_one_incident(seed):
    inc, act = seed
    out = textops.context_pack(inc, act, as_of="2024-01-01T12:00:00", incident_id=5).first()
    assert "SPECIFIC INCIDENT DETAILS (ID 5)" in out["context"] and out["incidents_total"] == 5
    assert out["remediations_text"].splitlines()[0] == "restart_container web ✓ at 2024-01-01T11:04:00"


def test_response_edges(spark):
    rows = [(1, "plain"), (2, "} {"), (3, "{}"), (4, None), (5, 'x {"suggestions": ["a"], "confidence": "high"} y')]
    got = {r["id"]: r for r in textops.parse_responses(spark.createDataFrame(rows, "id int, response string")).collect()}
    assert got[1]["root_cause"] == got[2]["root_cause"] == "Unable to parse structured response"
    assert got[3]["json"] == "{}" and got[3]["root_cause"] is None
    assert got[5]["suggestions"] == ["a"] and got[5]["confidence"] == "high"


def test_every_alert_rule_has_samples(spark, small):
    """Each of the 15 rules is evaluated, over all rows of its tables."""
    from fleetlens.catalog import timeseries as ts
    from fleetlens.operators import promlike as prom

    got = {r["alert"] for r in ts.i10_all(spark, small).select("alert").distinct().collect()}
    assert got == {r[0] for r in prom.RULES} and len(got) == 15
    last = {r["metric"]: r["n"] for r in ts._other_samples(spark, small).groupBy("metric", "labels").agg(F.max("value").alias("v")).groupBy("metric").agg(F.sum("v").alias("n")).collect()}
    assert last["remediation_actions_total"] == t.remediation_actions(spark, small).count()
    assert last["remediation_failures_total"] == t.remediation_actions(spark, small).filter("not success").count()
    assert last["incidents_total"] == t.incidents(spark, small).count()
    assert last["database_errors_total"] == t.incident_events(spark, small).filter("type = 'error'").count()


def test_incident_detail_takes_more_tasks_for_more_rows(spark, monkeypatch):
    """Tasks follow the rows, not a setting; a hot id takes the other way to the same rows, in order; ids repeat and are null."""
    inc = spark.createDataFrame([(i if i < 300 else None if i < 302 else 7, f"t{i}") for i in range(304)], "id long, type string")
    acts = [(i % 200 if i % 3 else 5, i * 7 % 1000, "restart", f"s{i}", True, i) for i in range(2000)] + [(None, 1, "restart", "s", True, 1)]
    act = spark.createDataFrame(acts, "incident_id long, timestamp long, action_type string, target string, success boolean, execution_time_ms int")
    whole = [tuple(r) for r in jn.incident_detail(inc, act).collect()]
    right = {}
    for k, *rest in acts:
        right.setdefault(k, []).append(tuple(rest))
    want = [(r["id"], r["type"], *a) for r in inc.collect() for a in (right.get(r["id"]) if r["id"] is not None else None) or [(None,) * 5]]
    assert sorted(map(str, whole)) == sorted(map(str, want))
    keys = [tuple((v is not None, v) for v in (r[0], r[2], r[3], r[4])) for r in whole]
    assert keys == sorted(keys)
    monkeypatch.setattr(jn, "DETAIL_ROWS", 50)
    many = jn.incident_detail(inc, act)
    assert many.select(F.spark_partition_id()).distinct().count() > 30
    monkeypatch.setattr(jn, "MAX_ROWS_PER_TASK", 100)
    monkeypatch.setattr(jn, "DETAIL_GROUPS", 1 << 20)
    hot = jn.incident_detail(inc, act)
    assert "LeftAnti" in hot._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, map(tuple, hot.collect()))) == sorted(map(str, map(tuple, many.collect()))) == sorted(map(str, whole))
