"""Views that present the given parquet tables as telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.dates import day_start, hour_start
from fleetlens.functions.numeric import fixed, flag
from fleetlens.plans.ordered import running
from fleetlens.plans.quantiles import linear, value_ranks
from fleetlens.schemas import REQUEST_BOUNDS


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _service(key: str, n: int) -> Column:
    return F.concat(F.lit("svc_"), (F.col(key) % n).cast("string"))


def metrics_wide(spark: SparkSession, path: str) -> DataFrame:
    """One row per (service, hour). Percentiles come from value counts, so an hour that holds a large part
    of all events is merged before it is shuffled and never gathered in one buffer."""
    ev = table(spark, path, "events").select(
        _service("user_id", 4).alias("service_name"),
        hour_start("ts").alias("timestamp"),
        "value",
        flag(F.col("event_type") == "error").alias("bad"),
    )
    keys = ["service_name", "timestamp"]
    counts = ev.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    total = F.sum("n")
    return (
        value_ranks(counts, keys, "value", "n")
        .groupBy(*keys)
        .agg(
            total.alias("request_count"),
            F.sum("bad").alias("error_count"),
            fixed(F.sum("bad") / total).alias("error_rate"),
            fixed(F.least(F.lit(100.0), F.sum(F.col("value") * F.col("n")) / total * 2)).alias("cpu_usage_percent"),
            fixed(F.sum(F.col("value") * F.col("n")) * 10).alias("memory_usage_mb"),
            fixed(F.least(F.lit(100.0), F.max("value"))).alias("memory_usage_percent"),
            fixed(linear("value", "n", 0.5)).alias("response_time_p50"),
            fixed(linear("value", "n", 0.95) * 10).alias("response_time_p95"),
        )
    )


# Which metric an event type stands for.
EVENT_METRICS = {
    "error": "error_rate",
    "click": "cpu_usage",
    "view": "memory_usage",
    "purchase": "response_time",
}
LONG_METRICS = ["cpu_usage", "disk_usage", "error_rate", "memory_usage", "response_time"]


def metrics_long(spark: SparkSession, path: str, hourly: bool = True) -> DataFrame:
    name = F.lit("disk_usage")
    for event, metric in EVENT_METRICS.items():
        name = F.when(F.col("event_type") == event, metric).otherwise(name)
    return table(spark, path, "events").select(
        _service("user_id", 4).alias("service"),
        (hour_start("ts") if hourly else F.col("ts")).alias("timestamp"),
        name.alias("metric_name"),
        "value",
        "event_id",
    )


def incidents(spark: SparkSession, path: str) -> DataFrame:
    kind = F.col("o_orderkey") % 6
    return table(spark, path, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("timestamp"),
        F.when(kind == 0, "health_check_failed")
        .when(kind == 1, "high_error_rate")
        .when(kind == 2, "cpu_spike")
        .when(kind == 3, "high_response_time")
        .when(kind == 4, "ml_anomaly")
        .otherwise("predicted_breach")
        .alias("type"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "CRITICAL")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "WARNING")
        .otherwise("INFO")
        .alias("severity"),
        F.when(F.col("o_orderstatus") == "O", "ACTIVE")
        .when(F.col("o_orderstatus") == "F", "RESOLVED")
        .otherwise("ESCALATED")
        .alias("status"),
        _service("o_custkey", 10).alias("affected_service"),
        (F.col("o_custkey") % 3600).cast("int").alias("resolution_time_seconds"),
    )


def remediation_actions(spark: SparkSession, path: str) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    return table(spark, path, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("incident_id"),
        F.col("l_shipdate").alias("timestamp"),
        F.when(kind == 0, "restart_container").when(kind == 1, "start_replica").otherwise("stop_replica").alias("action_type"),
        _service("l_suppkey", 10).alias("target"),
        (F.col("l_returnflag") != "R").alias("success"),
        (F.col("l_quantity") * 100).cast("int").alias("execution_time_ms"),
    )


def incident_events(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("type"),
        _service("user_id", 4).alias("service_name"),
        "value",
    )


def failures(spark: SparkSession, path: str) -> DataFrame:
    """The incidents that count as failures of a service: those of type `error`. Ordinary traffic is no failure, and
    with it nearly every hour of every service would have one."""
    return incident_events(spark, path).filter(F.col("type") == "error")


def counters(spark: SparkSession, path: str) -> DataFrame:
    """A counter per (service, event type) that falls back to 0 at every 50th event."""
    ev = table(spark, path, "events").select(
        _service("user_id", 4).alias("service"), "event_type", F.col("ts").alias("timestamp"), "event_id"
    )
    counted = running(ev, ["service", "event_type"], ["timestamp", "event_id"], sums={"n": F.lit(1)})
    return counted.select(
        "service",
        "event_type",
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        "timestamp",
        "event_id",
        (F.col("n") % 50).alias("value"),
    )


def hist_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Cumulative request-time buckets per (service, day), finite bounds only."""
    ev = table(spark, path, "events").select(
        _service("user_id", 4).alias("service"), day_start("ts").alias("timestamp"), (F.col("value") / 100).alias("v")
    )
    wide = ev.groupBy("service", "timestamp").agg(
        *[F.sum(flag(F.col("v") <= b)).alias(str(i)) for i, b in enumerate(REQUEST_BOUNDS)]
    )
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"`{i}`").alias("cum")) for i, b in enumerate(REQUEST_BOUNDS)])
    return wide.select("service", "timestamp", F.inline(pairs))


def logs(spark: SparkSession, path: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return table(spark, path, "events").select(
        F.col("ts").alias("timestamp"),
        "event_id",
        F.when(F.col("user_id") % 2 == 0, "app").otherwise("bot").alias("service"),
        F.concat_ws(" ", level, "event_type", "props").alias("line"),
        "props",
    )


def scores(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        fixed(F.lit(0.1) - F.col("value") / 500, 6).alias("anomaly_score"),
        (F.col("value") > 50).alias("is_anomaly"),
        F.when(F.col("event_type") == "error", "anomaly").otherwise("normal").alias("label"),
    )


def predictions(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("value") / 100
    return table(spark, path, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        fixed(F.least(F.lit(1.0), p)).alias("failure_probability"),
        F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low").alias("risk_level"),
    )


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    """The hourly mean of 24 rows earlier as forecast of each hourly mean."""
    from fleetlens.plans.ordered import with_history

    hourly = (
        metrics_long(spark, path).groupBy("service", "metric_name", "timestamp").agg(fixed(F.avg("value")).alias("actual"))
    )
    return with_history(
        hourly,
        ["service", "metric_name"],
        ["timestamp"],
        24,
        lambda d, w: d.withColumn("predicted_value", F.lag("actual", 24).over(w)),
    ).select(
        "service", "metric_name", F.col("timestamp").alias("predicted_timestamp"), "predicted_value", "actual"
    )


# Names of the three models in a registry.
MODELS = ["anomaly_detector", "failure_predictor", "forecaster"]


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A model registry: one row per training run."""
    which = F.col("o_custkey") % 3
    return table(spark, path, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(which == 0, MODELS[0]).when(which == 1, MODELS[1]).otherwise(MODELS[2]).alias("model_name"),
        F.when(which == 0, "isolation_forest").when(which == 1, "boosted_trees").otherwise("seasonal_trend").alias("model_type"),
        F.col("o_orderdate").alias("trained_at"),
        (F.lit(0.5) + (F.col("o_orderkey") % 50) / 100).alias("accuracy"),
        (F.col("o_totalprice") > 100000).alias("is_active"),
    )


def config_rows(spark: SparkSession, path: str) -> DataFrame:
    """One configuration document per customer; some lack the breaker part, some are not JSON."""
    k = F.col("c_custkey")
    body = F.concat(
        F.lit('{"thresholds": {"cpu_percent": '), (k % 40 + 50).cast("string"),
        F.lit(', "error_rate": 0.'), (k % 9 + 1).cast("string"), F.lit("}"),
        F.when(k % 3 == 0, F.concat(F.lit(', "circuit_breaker": {"failure_threshold": '), (k % 5 + 1).cast("string"), F.lit("}")))
        .when(k % 3 == 1, F.concat(F.lit(', "remediation": {"max_restarts_per_5min": '), (k % 7 + 1).cast("string"), F.lit("}")))
        .otherwise(F.lit("")),
        F.lit("}"),
    )
    return table(spark, path, "customer").select(
        F.concat(F.lit("cfg_"), k.cast("string")).alias("key"),
        F.when(k % 11 == 0, "not json").otherwise(body).alias("value"),
        F.lit("1995-01-01").cast("timestamp_ntz").alias("updated_at"),
        F.lit("system").alias("updated_by"),
    )


def config_updates(spark: SparkSession, path: str) -> DataFrame:
    """Configuration writes: several per key over time, some for keys not seen before."""
    return table(spark, path, "orders").select(
        F.concat(F.lit("cfg_"), (F.col("o_custkey") + F.col("o_orderkey") % 2 * 1000).cast("string")).alias("key"),
        F.concat(F.lit('{"limit": '), F.col("o_orderkey").cast("string"), F.lit("}")).alias("value"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderkey").alias("seq"),
    )


def alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert payloads: one JSON document with two alerts per event; a missing severity in every fifth."""
    ev = table(spark, path, "events")
    name = (
        F.when(F.col("event_type") == "error", "HighErrorRate")
        .when(F.col("event_type") == "click", "HighCPUUsage")
        .when(F.col("event_type") == "view", "DatabaseConnectionIssues")
        .when(F.col("event_type") == "purchase", "ApplicationDown")
        .otherwise("HighMemoryUsage")
    )
    severity = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit(', "severity": "'), F.when(F.col("value") > 50, "critical").otherwise("info"), F.lit('"'))
    )
    first = F.concat(
        F.lit('{"status": "'), F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("firing"),
        F.lit('", "labels": {"alertname": "'), name, F.lit('"'), severity,
        F.lit('}, "annotations": {"summary": "user '), F.col("user_id").cast("string"), F.lit('"}}'),
    )
    second = F.lit('{"status": "firing", "labels": {"alertname": "CpuErrorBoth"}}')
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit('{"alerts": ['), first, F.lit(", "), second, F.lit("]}")).alias("payload"),
    )
