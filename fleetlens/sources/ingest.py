"""Readers and writers: metric samples, logs, exposition text, alerts, incidents, model registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.dates import before, moment, seconds_between
from fleetlens.plans.ordered import running
from fleetlens.sources.partitions import append_batch

ALERT_SCHEMA = (
    "alerts array<struct<status string, labels map<string,string>, annotations map<string,string>>>"
)


def append_by_day(df: DataFrame, path: str, batch: str, ts: str = "timestamp", keys: Sequence[str] = ()) -> None:
    """Append a named batch under one folder per key and day; repeated, it adds nothing. The number of files of a day
    follows its size."""
    append_batch(df.withColumn("date", F.to_date(ts)), path, [*keys, "date"], batch)


def append_metrics(df: DataFrame, path: str, batch: str) -> None:
    append_by_day(df, path, batch, keys=["service_name"])


def append_predictions(kind: str, df: DataFrame, path: str, batch: str) -> None:
    """Append a batch of scores, failures, forecasts, analyses or actions to its log."""
    ts = {"forecasts": "predicted_timestamp", "analyses": "analyzed_at"}.get(kind, "timestamp")
    append_by_day(df, f"{path}/{kind}", batch, ts)


def export_range(df: DataFrame, start=None, end=None, as_of=None, days: int = 30) -> DataFrame:
    """Rows with a time in [start, end], in time order; without a range the last 30 days."""
    lo = moment(start) if start is not None else before(as_of, days=days)
    hi = moment(end) if end is not None else moment(as_of)
    return df.filter(F.col("timestamp").between(lo, hi)).orderBy("timestamp")


def export_metrics(df: DataFrame, fmt: str, path: str, start=None, end=None, as_of=None) -> None:
    """Write a time range as CSV or JSON; the files together are in time order."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"format must be csv or json, not {fmt!r}")
    out = export_range(df, start, end, as_of).write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.json(path)


def save_training(df: DataFrame, csv_path: str, history_path: str, batch: str) -> None:
    """Write a labelled set as CSV and append it, without labels, to the history."""
    df.write.mode("overwrite").option("header", True).csv(csv_path)
    append_metrics(df.drop("label"), history_path, batch)


def alert_type(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(n.contains("cpu"), "CPU_SPIKE")
        .when(n.contains("error"), "ERROR_RATE")
        .when(n.contains("connection"), "DATABASE_CONNECTION")
        .when(n.contains("down"), "SERVICE_DOWN")
        .otherwise("SYSTEM_ERROR")
    )


def alerts_to_incidents(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One active incident per firing alert of each payload. Works on batches and streams."""
    rest = [c for c in df.columns if c != payload]
    one = df.select(*rest, F.explode(F.from_json(payload, ALERT_SCHEMA)["alerts"]).alias("a")).filter(
        F.col("a.status") == "firing"
    )
    name = F.coalesce(F.col("a.labels")["alertname"], F.lit("Unknown"))
    return one.select(
        *rest,
        alert_type(name).alias("type"),
        F.upper(F.coalesce(F.col("a.labels")["severity"], F.lit("warning"))).alias("severity"),
        F.coalesce(F.col("a.annotations")["summary"], name).alias("description"),
        F.lit("ACTIVE").alias("status"),
        F.to_json("a").alias("details"),
    )


def label_logs(df: DataFrame, container: str, stream: str, service: str) -> DataFrame:
    """Give log lines a label map; a leading slash of the container name goes."""
    labels = F.create_map(
        F.lit("container"), F.regexp_extract(container, "^/?(.*)$", 1),
        F.lit("stream"), F.col(stream),
        F.lit("service"), F.col(service),
    )
    return df.withColumn("labels", labels)


def read_logs(spark: SparkSession, path: str, labels: dict[str, str] | None = None, streaming: bool = False) -> DataFrame:
    """Text lines of container logs as (labels, line); the container is the folder name."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.text(path).withColumn("file", F.col("_metadata.file_path"))
    given = [x for k, v in (labels or {}).items() for x in (F.lit(k), F.lit(v))]
    container = F.element_at(F.split("file", "/"), -2)
    return raw.select(F.create_map(F.lit("container"), container, *given).alias("labels"), F.col("value").alias("line"))


SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"


def parse_samples(df: DataFrame, line: str = "value") -> DataFrame:
    """Exposition lines as (metric, labels, value); comments and blank lines drop out."""
    rest = [c for c in df.columns if c != line]
    text = F.trim(F.col(line))
    kept = df.filter((text != "") & ~text.startswith("#"))
    names = F.regexp_extract_all(F.regexp_extract(text, SAMPLE, 2), F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), 1)
    values = F.regexp_extract_all(F.regexp_extract(text, SAMPLE, 2), F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), 2)
    number = F.regexp_extract(text, SAMPLE, 3)
    number = F.when(number == "+Inf", "Infinity").when(number == "-Inf", "-Infinity").otherwise(number)
    return kept.select(
        *rest,
        F.regexp_extract(text, SAMPLE, 1).alias("metric"),
        F.map_from_arrays(names, values).alias("labels"),
        number.try_cast("double").alias("value"),
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return parse_samples(spark.read.text(path))


def incident_rows(detections: DataFrame, key: Sequence[str]) -> DataFrame:
    """Detections as incident rows. The id is a 128-bit digest of the key, so a repeated batch gives the same ids."""
    return detections.select(
        F.md5(F.to_json(F.struct(*key, "type", "service_name"))).alias("id"),
        "timestamp",
        "type",
        "severity",
        F.to_json("details").alias("details"),
        F.lit("ACTIVE").alias("status"),
        F.col("service_name").alias("affected_service"),
    )


def log_incidents(detections: DataFrame, path: str, key: Sequence[str], batch: str) -> None:
    append_by_day(incident_rows(detections, key), path, batch)


def resolve_incidents(inc: DataFrame, act: DataFrame, as_of=None) -> DataFrame:
    """Close every incident that has a successful action, at the time of the first one. With `as_of`, rows
    that change are stamped `updated_at`."""
    done = act.filter("success").groupBy(F.col("incident_id").alias("id")).agg(F.min("timestamp").alias("_done"))
    out = inc.join(done, "id", "left")
    fixed = F.col("_done").isNotNull()
    earlier = F.col("resolved_at") if "resolved_at" in inc.columns else F.lit(None).cast("timestamp_ntz")
    cols = {
        "status": F.when(fixed, "RESOLVED").otherwise(F.col("status")),
        "resolved_at": F.coalesce("_done", earlier),
        "resolution_time_seconds": F.when(fixed, F.round(seconds_between("timestamp", "_done")).cast("int")).otherwise(
            F.col("resolution_time_seconds")
        ),
    }
    if as_of is not None:
        stamped = F.col("updated_at") if "updated_at" in inc.columns else F.lit(None).cast("timestamp_ntz")
        cols["updated_at"] = F.when(fixed, moment(as_of)).otherwise(stamped)
    return out.withColumns(cols).drop("_done")


def number_versions(reg: DataFrame, order: Sequence[str] = ("trained_at", "id")) -> DataFrame:
    """Version 1, 2, ... of each model in training order."""
    return running(reg, ["model_name"], order, sums={"version": F.lit(1)})


def register_models(reg: DataFrame, new: DataFrame, order: Sequence[str] = ("trained_at", "id")) -> DataFrame:
    """New registry rows with the versions after the highest one of their model (1 for a new model)."""
    top = reg.groupBy("model_name").agg(F.max("version").alias("_top"))
    numbered = number_versions(new, order).join(top, "model_name", "left")
    return numbered.withColumn("version", F.col("version") + F.coalesce("_top", F.lit(0))).drop("_top")


def latest_version(reg: DataFrame) -> DataFrame:
    """The newest registry row of each model."""
    w = Window.partitionBy("model_name").orderBy(F.desc("version"))
    return reg.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
