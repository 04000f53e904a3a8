"""Detectors, action choice, health verdicts and risk levels as column expressions.

A detector is a nullable struct (type, severity, details) over one row; details is JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.dates import moment, seconds_between
from fleetlens.functions.numeric import col
from fleetlens.schemas import HIGH_RISK, MEDIUM_RISK, limit_of

METRICS = ["total_requests", "total_errors", "error_rate", "cpu_usage_percent", "memory_usage_mb", "response_time_p50_ms", "response_time_p95_ms", "response_time_p99_ms"]


def health_frame(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Flatten health documents (service, timestamp, metrics, flags); a null document is an unreachable
    service. `service_name`, `timestamp` and `error` beside the document say which poll failed."""
    rest = [c for c in df.columns if c != doc]
    fields = df.schema[doc].dataType["metrics"].dataType.names
    return df.select(
        *rest,
        F.col(doc).isNotNull().alias("reachable"),
        *[F.col(f"{doc}.metrics.{m}").alias(m) for m in METRICS if m in fields],
        F.coalesce(F.col(f"{doc}.flags.cpu_spike"), F.lit(False)).alias("cpu_spike_flag"),
    )


def _have(df: DataFrame, *names: str) -> Column:
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(None)


def _reachable(df: DataFrame) -> Column:
    return F.col("reachable") if "reachable" in df.columns else F.lit(True)


def incident(when: Column, type: str, severity: Column, **details: Column) -> Column:
    body = F.to_json(F.struct(*[v.alias(k) for k, v in details.items()]))
    made = F.struct(F.lit(type).alias("type"), severity.alias("severity"), body.alias("details"))
    return F.when(when, made)


def health_check_failed(df: DataFrame) -> Column:
    text = F.coalesce(_have(df, "error").cast("string"), F.lit("Failed to connect to health endpoint"))
    return incident(~_reachable(df), "health_check_failed", F.lit("CRITICAL"), reason=F.lit("health_endpoint_unreachable"), message=text)


def high_error_rate(df: DataFrame) -> Column:
    er, limit = F.coalesce(_have(df, "error_rate"), F.lit(0.0)), limit_of(df, "error_rate")
    return incident(
        _reachable(df) & (er > limit), "high_error_rate", F.when(er > limit * 3, "CRITICAL").otherwise("WARNING"),
        error_rate=er, threshold=limit,
        total_requests=F.coalesce(_have(df, "total_requests", "request_count"), F.lit(0)),
        total_errors=F.coalesce(_have(df, "total_errors", "error_count"), F.lit(0)),
    )


def cpu_spike(df: DataFrame) -> Column:
    cpu, limit = F.coalesce(_have(df, "cpu_usage_percent"), F.lit(0.0)), limit_of(df, "cpu_percent")
    flagged = F.coalesce(_have(df, "cpu_spike_flag").cast("boolean"), F.lit(False))
    return incident(
        _reachable(df) & ((cpu > limit) | flagged), "cpu_spike", F.when(cpu > limit * 1.2, "CRITICAL").otherwise("WARNING"),
        cpu_usage_percent=cpu, threshold=limit, simulated=flagged,
    )


def high_response_time(df: DataFrame) -> Column:
    p95, limit = _have(df, "response_time_p95_ms", "response_time_p95").cast("double"), limit_of(df, "response_time_ms")
    return incident(
        _reachable(df) & (p95 > limit), "high_response_time", F.when(p95 > limit * 2, "CRITICAL").otherwise("WARNING"),
        p95_response_time_ms=p95, threshold=limit,
        p50_ms=_have(df, "response_time_p50_ms", "response_time_p50").cast("double"),
        p99_ms=_have(df, "response_time_p99_ms", "response_time_p99").cast("double"),
    )


def ml_anomaly(df: DataFrame) -> Column:
    """For rows with `is_anomaly`, `anomaly_severity` and, if at hand, ordered `contributions`."""
    sev = F.col("anomaly_severity")
    top = F.slice("contributions", 1, 3) if "contributions" in df.columns else F.lit(None).cast("string")
    return incident(
        F.col("is_anomaly").cast("boolean") & (sev >= limit_of(df, "ml_anomaly_severity")), "ml_anomaly",
        F.when(sev >= 85, "CRITICAL").otherwise("WARNING"),
        anomaly_score=_have(df, "anomaly_score").cast("double"), anomaly_severity=sev, top_contributing_features=top,
    )


def predicted_breach(alerts: DataFrame, keys: Sequence[str] = ("service_name",)) -> DataFrame:
    """One incident per key from its breach alerts: the one with the largest predicted value."""
    worst = most_severe(alerts, keys)
    text = F.format_string("Predicted %s will exceed %s within 1 hour", F.col("metric"), F.col("threshold").cast("string"))
    made = incident(
        F.lit(True), "predicted_breach", F.col("severity"), metric=F.col("metric"), predicted_value=F.col("predicted_value"),
        threshold=F.col("threshold"), time_to_breach=F.lit("within 1 hour"), message=text,
    )
    return worst.select(*keys, made.alias("i")).select(*keys, "i.*")


def most_severe(alerts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The alert with the largest predicted value of each key."""
    cols = [c for c in alerts.columns if c not in keys]
    pick = F.max_by(F.struct(*cols), F.struct("predicted_value", "metric"))
    return alerts.groupBy(*keys).agg(pick.alias("_w")).select(*keys, "_w.*")


def detect_all(df: DataFrame, extra: Sequence[Column] = (), ids: Sequence[str] = ("service_name", "timestamp")) -> DataFrame:
    """Every incident of every row, from one scan. `extra` adds detectors of the same shape."""
    found = [health_check_failed(df), high_error_rate(df), cpu_spike(df), high_response_time(df), *extra]
    if {"is_anomaly", "anomaly_severity"} <= set(df.columns):
        found.append(ml_anomaly(df))
    each = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return df.select(*ids, each.alias("i")).select(*ids, "i.*")


# Reason of the restart for each incident type that has one.
REASONS = {
    "health_check_failed": "Health check failed - app unresponsive",
    "high_error_rate": "High error rate: %.2f%% - restarting to recover",
    "cpu_extreme": "Extreme CPU usage: %s%% - forcing restart",
    "cpu_spike": "CPU spike detected: %s%% - restarting to recover",
    "high_response_time": "High response time: P95=%sms - restarting",
}
CPU_EXTREME = 95


def choose_action(inc: DataFrame, service: str = "service_name") -> DataFrame:
    """Action, target and reason for each incident; null where no action is defined."""
    def number(field):
        return F.coalesce(F.get_json_object("details", f"$.{field}").try_cast("double"), F.lit(0.0))

    kind, cpu = F.col("type"), number("cpu_usage_percent")
    cpu_text = cpu.cast("string")
    spike = F.when(cpu > CPU_EXTREME, F.format_string(REASONS["cpu_extreme"], cpu_text)).otherwise(
        F.format_string(REASONS["cpu_spike"], cpu_text)
    )
    p95 = number("p95_response_time_ms").cast("string")
    texts = {
        "health_check_failed": F.lit(REASONS["health_check_failed"]),
        "high_error_rate": F.format_string(REASONS["high_error_rate"], number("error_rate") * 100),
        "cpu_spike": spike,
        "high_response_time": F.format_string(REASONS["high_response_time"], p95),
    }
    reason = F.coalesce(*[F.when(kind == k, text) for k, text in texts.items()])
    acts = reason.isNotNull()
    return inc.withColumns(
        {"action_type": F.when(acts, "restart_container"), "target": F.when(acts, F.col(service)), "reason": reason}
    )


def health_verdict(df: DataFrame) -> DataFrame:
    """Status and issues from available connections, utilisation, hit ratio, rollback ratio and deadlocks."""
    def issue(when, severity, type, message):
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(type).alias("type"), message.alias("message")))

    free, used, hit = F.col("available"), F.col("utilization_percent"), F.col("cache_hit_ratio")
    back, dead = F.col("rollback_ratio"), F.col("deadlocks")
    found = F.array(
        issue(free < 10, "critical", "connection_pool_exhaustion", F.format_string("Only %d connections available", free.cast("long"))),
        issue((free >= 10) & (used > 80), "warning", "high_connection_usage", F.format_string("Connection pool %s%% utilized", used.cast("string"))),
        issue(hit < 95, "warning", "low_cache_hit_ratio", F.format_string("Cache hit ratio: %.2f%% (should be >95%%)", hit.cast("double"))),
        issue(back > 5, "warning", "high_rollback_ratio", F.format_string("Rollback ratio: %s%% (should be <5%%)", back.cast("string"))),
        issue(dead > 0, "critical", "deadlocks_detected", F.format_string("%d deadlocks detected", dead.cast("long"))),
    )
    out = df.withColumn("issues", F.filter(found, lambda x: x.isNotNull()))
    status = (
        F.when(F.exists("issues", lambda x: x["severity"] == "critical"), "critical")
        .when(F.size("issues") > 0, "warning")
        .otherwise("healthy")
    )
    return out.withColumn("status", status)


# When a model is trained again.
RETRAIN_HOURS, RETRAIN_PREDICTIONS, MIN_ACCURACY, MAX_MAE = 24, 100, 0.70, 20.0


def should_retrain(status: DataFrame, as_of) -> DataFrame:
    """Decision and reason per model from last_trained, predictions_since_train, accuracy and mae."""
    hours = seconds_between("last_trained", moment(as_of)) / 3600
    n = F.col("predictions_since_train")
    bad_fit = (F.col("model_name") == "forecaster") & (F.col("mae") > MAX_MAE)
    bad_class = (F.col("model_name") != "forecaster") & (F.col("accuracy") < MIN_ACCURACY)
    reason = (
        F.when(F.col("last_trained").isNull(), "Model never trained")
        .when(hours >= RETRAIN_HOURS, F.format_string("Scheduled retrain (%.1f hours since last training)", hours))
        .when(n >= RETRAIN_PREDICTIONS, F.format_string("Sufficient new data (%d predictions)", n))
        .when(bad_fit, F.format_string("Performance degraded (MAE: %.2f)", F.col("mae").cast("double")))
        .when(bad_class, F.format_string("Performance degraded (accuracy: %.2f%%)", F.col("accuracy").cast("double") * 100))
    )
    return status.withColumn("should_retrain", reason.isNotNull()).withColumn(
        "retrain_reason", F.coalesce(reason, F.lit("No retrain needed"))
    )


def risk_level(p: Column | str) -> Column:
    return F.when(col(p) >= HIGH_RISK, "high").when(col(p) >= MEDIUM_RISK, "medium").otherwise("low")


def risk_message(level: Column | str) -> Column:
    word = F.when(col(level) == "high", "High").when(col(level) == "medium", "Moderate").otherwise("Low")
    return F.concat(word, F.lit(" risk of failure in the next hour"))


def proactive_incidents(pr: DataFrame, probability: str = "failure_probability") -> DataFrame:
    """A `predicted_failure` incident for each high or medium prediction."""
    rest = [c for c in pr.columns if c not in ("risk_level", probability)]
    return pr.filter(F.col("risk_level").isin("high", "medium")).select(
        *rest,
        F.lit("predicted_failure").alias("type"),
        F.when(F.col("risk_level") == "high", "HIGH").otherwise("MEDIUM").alias("severity"),
        F.to_json(F.struct(F.col(probability).alias("probability"), "risk_level", risk_message("risk_level").alias("message"))).alias("details"),
    )
