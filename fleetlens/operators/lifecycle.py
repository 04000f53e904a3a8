"""When models and jobs are due, and what the last training runs were."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.dates import moment, seconds_between
from fleetlens.operators.rules import should_retrain
from fleetlens.sources.partitions import append_batch
from fleetlens.sources.tables import MODELS

# Seconds between runs of the periodic jobs.
JOB_INTERVALS = {"cleanup": 86400, "failure_check": 300, "retrain_check": 3600}


def due_jobs(job_runs: DataFrame, as_of, intervals: dict[str, int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Per job (and key): last run and whether the next one is due; a job that never ran is due.

    `job_runs` holds (keys..., job, started_at)."""
    every = JOB_INTERVALS if intervals is None else intervals
    jobs = F.explode(F.create_map(*[F.lit(x) for kv in every.items() for x in kv])).alias("job", "every_s")
    known = job_runs.filter(F.col("started_at") <= moment(as_of))
    last = known.groupBy(*keys, "job").agg(F.max("started_at").alias("last_run"))
    wanted = (job_runs.select(*keys).distinct() if keys else job_runs.sparkSession.range(1).select()).select(*keys, jobs)
    out = wanted.join(last, [*keys, "job"], "left")
    due = F.col("last_run").isNull() | (seconds_between("last_run", moment(as_of)) >= F.col("every_s"))
    return out.withColumn("due", due)


def predictions_since(log: DataFrame, trained: DataFrame) -> DataFrame:
    """Predictions of each model made after its last training. The log shrinks to one row per model and
    moment before the join."""
    on = [c for c in trained.columns if c != "last_trained"]
    counted = log.groupBy(*on, "timestamp").agg(F.count("*").alias("_n"))
    late = F.when(F.col("timestamp") > F.col("last_trained"), F.col("_n")).otherwise(0)
    return counted.join(trained, on).groupBy(*on).agg(F.sum(late).alias("predictions_since_train"))


def model_status(reg: DataFrame, log: DataFrame, as_of, names: Sequence[str] = tuple(MODELS)) -> DataFrame:
    """Last training, predictions since, accuracy or mae, and the retrain decision of each model.

    `log` holds (model_name, timestamp)."""
    seen = reg.filter(F.col("trained_at") <= moment(as_of))
    fit = F.max_by(F.struct("accuracy", (F.col("mae") if "mae" in reg.columns else F.lit(None).cast("double")).alias("mae")), F.struct("trained_at", "id"))
    last = seen.groupBy("model_name").agg(F.max("trained_at").alias("last_trained"), fit.alias("_f"))
    wanted = reg.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("model_name"))
    base = wanted.join(last, "model_name", "left")
    since = predictions_since(log, base.select("model_name", "last_trained"))
    out = base.join(since, "model_name", "left").select(
        "model_name", "last_trained", "_f.accuracy", "_f.mae", F.coalesce("predictions_since_train", F.lit(0)).alias("predictions_since_train")
    )
    return should_retrain(out, as_of)


def retrain_cycle(status: DataFrame, trainers: dict[str, Callable[[], dict]], force: bool = False, every: bool = False) -> list[dict]:
    """Train every model that is due (all with `force`) and report each outcome. One row per model is read.

    Models without a trainer are left out, or reported as skipped with `every`."""
    if not every:
        status = status.filter(F.col("model_name").isin(list(trainers)))
    report = []
    for r in status.orderBy("model_name").collect():
        if r["model_name"] not in trainers:
            report.append({"model": r["model_name"], "status": "skipped", "reason": "No trainer"})
            continue
        if not (force or r["should_retrain"]):
            report.append({"model": r["model_name"], "status": "skipped", "reason": r["retrain_reason"]})
            continue
        why = "Forced retraining" if force else r["retrain_reason"]
        try:
            report.append({"model": r["model_name"], "status": "success", "reason": why, "result": trainers[r["model_name"]]()})
        except Exception as e:  # one model's failure, of whatever kind, does not end the cycle
            report.append({"model": r["model_name"], "status": "failed", "reason": str(e)})
    return report


# What each model is called in the registry.
MODEL_TYPES = {"anomaly_detector": "isolation_forest", "failure_predictor": "boosted_trees", "forecaster": "seasonal_trend"}


def registry_rows(reg: DataFrame, report: list[dict], as_of) -> DataFrame:
    """One row per model of a cycle; a trained one has the registry row to append, with the next version.

    The next version follows the highest one of the model up to `as_of`; a registry without versions numbers its runs.
    `append_registry` stores the rows. Result facts other than accuracy and mae become JSON metadata."""
    made = []
    for r in report:
        facts = r.get("result", {})
        rest = {k: v for k, v in facts.items() if k not in ("accuracy", "mae")}
        made.append((
            r["model"], r["status"], r["reason"], MODEL_TYPES.get(r["model"]), facts.get("accuracy"), facts.get("mae"),
            json.dumps(rest, default=str) if "result" in r else None,
        ))
    schema = "model_name string, status string, reason string, model_type string, accuracy double, mae double, metadata string"
    done = reg.sparkSession.createDataFrame(made, schema)
    top = F.max("version") if "version" in reg.columns else F.count("*")
    runs = reg.filter(F.col("trained_at") <= moment(as_of)).groupBy("model_name").agg(top.cast("long").alias("_runs"))
    trained = F.col("status") == "success"
    return done.join(runs, "model_name", "left").select(
        F.col("model_name").alias("model"), "status", "reason",
        F.when(trained, F.col("model_type")).alias("model_type"),
        F.when(trained, F.coalesce("_runs", F.lit(0)) + 1).alias("version"),
        "accuracy", "mae", "metadata",
        F.when(trained, moment(as_of)).alias("trained_at"),
    )


def append_registry(rows: DataFrame, path: str, as_of) -> None:
    """Add the trained models of a cycle to the stored registry; the cycle repeated adds nothing."""
    trained = rows.filter(F.col("status") == "success").select(F.col("model").alias("model_name"), "model_type", "version", "accuracy", "mae", "metadata", "trained_at")
    append_batch(trained, path, ["model_name"], str(as_of).replace(" ", "T").replace(":", "."))


def cycle_summary(report: list[dict]) -> dict:
    done = [r for r in report if r["status"] != "skipped"]
    return {"total": len(done), "successful": sum(r["status"] == "success" for r in done)}
