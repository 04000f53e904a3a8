"""Column names, enums, thresholds and bounds the operators agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["service_name"]
ORDER = ["timestamp"]

# Older names of the canonical metric columns.
METRIC_ALIASES = {
    "cpu_percent": "cpu_usage_percent",
    "cpu_usage": "cpu_usage_percent",
    "memory_percent": "memory_usage_percent",
    "memory_mb": "memory_usage_mb",
    "memory_usage": "memory_usage_mb",
    "disk_usage": "disk_usage_percent",
    "response_time": "response_time_p95",
    "service": "service_name",
}

# Enumerations.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "WARNING", "INFO"]
STATUSES = ["ACTIVE", "RESOLVED", "ESCALATED"]
BREAKER_STATES = ["CLOSED", "OPEN", "HALF_OPEN"]
ML_INCIDENT_TYPES = ["ml_anomaly", "predicted_breach", "predicted_failure"]

# Default detection thresholds.
THRESHOLDS = {
    "error_rate": 0.2,
    "cpu_percent": 80.0,
    "response_time_ms": 500.0,
    "memory_mb": 1024.0,
    "ml_anomaly_severity": 70.0,
}

# Limits a forecast mean is compared with.
FORECAST_THRESHOLDS = {
    "cpu_usage_percent": 80.0,
    "memory_usage_mb": 7000.0,
    "error_rate": 0.10,
    "response_time_p95": 2000.0,
}

# Histogram bucket bounds in seconds.
REQUEST_BOUNDS = [0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0, 10.0]
REMEDIATION_BOUNDS = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]

# Breaker defaults.
BREAKER = {"max_actions": 3, "window_s": 300, "cooldown_s": 120}

# Risk cuts of a failure probability.
HIGH_RISK, MEDIUM_RISK = 0.7, 0.4


def canonical(df: DataFrame) -> DataFrame:
    """Rename older metric column names; a name already present wins."""
    for old, new in METRIC_ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def to_long(df: DataFrame, metrics: list[str], ids: list[str]) -> DataFrame:
    """One row per metric and sample: (ids..., metric_name, value)."""
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(ids, metrics, "metric_name", "value").filter(F.col("value").isNotNull())


def to_wide(df: DataFrame, metrics: list[str], ids: list[str]) -> DataFrame:
    """Mean per (ids, metric); the metric list is given, so no job looks for it."""
    return df.groupBy(*ids).pivot("metric_name", metrics).agg(F.avg("value"))


def threshold_row(spark: SparkSession, values: dict[str, float] | None = None) -> DataFrame:
    """The default thresholds as a one-row table."""
    v = {**THRESHOLDS, **(values or {})}
    return spark.range(1).select(*[F.lit(x).alias(f"th_{k}") for k, x in v.items()])


def limit_of(df: DataFrame, name: str) -> Column:
    """The threshold column if the frame carries one, else the default value."""
    return F.coalesce(F.col(f"th_{name}"), F.lit(THRESHOLDS[name])) if f"th_{name}" in df.columns else F.lit(THRESHOLDS[name])
