"""Statistics over incidents, actions, metrics, scores and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.dates import before, moment, seconds_between
from fleetlens.functions.numeric import col, fixed, ratio
from fleetlens.operators.joins import match_anomalies, match_forecasts, match_predictions
from fleetlens.plans.ordered import last_n
from fleetlens.plans.quantiles import grouped_quantiles
from fleetlens.schemas import ML_INCIDENT_TYPES


def remediation_stats(act: DataFrame, as_of, days: float = 7) -> DataFrame:
    """Attempts, successes, success rate and mean time per action and target over the last days."""
    n, ok = F.count("*"), F.count_if("success")
    return (
        act.filter(F.col("timestamp") > before(as_of, days=days))
        .groupBy("action_type", "target")
        .agg(
            n.alias("total_attempts"),
            ok.alias("successful"),
            fixed(ok * 100.0 / n, 2).alias("success_rate"),
            F.avg("execution_time_ms").alias("avg_execution_time_ms"),
        )
        .orderBy(F.desc("total_attempts"), "action_type", "target")
    )


def metric_stats(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sample count, time range, means and sample deviations."""
    span = seconds_between(F.min("timestamp"), F.max("timestamp")) / 3600
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_samples"),
        F.min("timestamp").alias("first_sample"),
        F.max("timestamp").alias("last_sample"),
        F.coalesce(span, F.lit(0.0)).alias("data_duration_hours"),
        fixed(F.coalesce(F.avg("cpu_usage_percent"), F.lit(0.0)), 2).alias("avg_cpu"),
        fixed(F.coalesce(F.avg("memory_usage_percent"), F.lit(0.0)), 2).alias("avg_memory"),
        fixed(F.coalesce(F.avg("error_rate"), F.lit(0.0)), 4).alias("avg_error_rate"),
        fixed(F.coalesce(F.stddev_samp("cpu_usage_percent"), F.lit(0.0)), 2).alias("std_cpu"),
        fixed(F.coalesce(F.stddev_samp("memory_usage_percent"), F.lit(0.0)), 2).alias("std_memory"),
    )


def metric_profile(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, deviation, min and max of each metric, one row per metric, from one pass."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(m).alias(f"{m}|{s}") for m in metrics for s, f in stats.items()])
    rows = [F.struct(F.lit(m).alias("metric"), *[F.col(f"`{m}|{s}`").alias(s) for s in stats]) for m in metrics]
    return wide.select(F.inline(F.array(*rows)))


def _one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Put one-row frames beside each other without a join."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def ml_summary(reg, sc, pr, fc, inc, as_of, hours: float = 24) -> DataFrame:
    """Models known and lately trained, mean accuracy, predictions of each kind and incidents from models."""
    since = before(as_of, hours=hours)
    scored = reg.filter(F.col("model_name").isin("anomaly_detector", "failure_predictor"))
    return _one_row(
        [
            scored.agg(
                F.countDistinct("model_name").alias("total_models"),
                F.count_if(F.col("trained_at") > since).alias("recently_trained"),
                F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("avg_accuracy"),
            ),
            sc.agg(F.count_if(F.col("timestamp") > since).alias("anomaly_detections")),
            pr.agg(F.count_if(F.col("timestamp") > since).alias("failure_predictions")),
            fc.agg(F.count_if(F.col("predicted_timestamp") > since).alias("forecasts")),
            inc.filter(F.col("type").isin(*ML_INCIDENT_TYPES)).agg(
                F.count_if(F.col("timestamp") > since).alias("ml_incidents_detected")
            ),
        ]
    )


def freshness(df: DataFrame, reg: DataFrame, as_of) -> DataFrame:
    """How much was collected, how old the newest sample is, and whether collection is running."""
    now = moment(as_of)
    row = _one_row(
        [
            df.agg(F.count("*").alias("metrics_collected"), F.max("timestamp").alias("latest_metric_timestamp")),
            reg.agg(F.count_if("is_active").alias("active_models")),
        ]
    )
    age = seconds_between("latest_metric_timestamp", now) / 60
    return row.withColumn("data_age_minutes", fixed(age, 1)).withColumn(
        "data_collection_active", F.coalesce(age < 5, F.lit(False))
    )


def retention_stats(inc: DataFrame, act: DataFrame, as_of, days: int = 180) -> DataFrame:
    cutoff = before(as_of, days=days)
    old = F.count_if(F.col("timestamp") < cutoff)
    return _one_row(
        [
            inc.agg(F.count("*").alias("total_incidents"), old.alias("old_incidents"), F.min("timestamp").alias("oldest_record")),
            act.agg(F.count("*").alias("total_remediation_actions"), old.alias("old_remediation_actions")),
        ]
    ).withColumn("cutoff", cutoff)


def summarize_metrics(df: DataFrame, keys: Sequence[str] = ("service_name",)) -> DataFrame:
    """Min, max and mean of cpu, memory and errors with the number of samples and their time range."""
    names = {"cpu": "cpu_usage_percent", "memory": "memory_usage_mb", "errors": "error_rate"}
    stats = {"min": F.min, "max": F.max, "avg": F.avg}
    return df.groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        F.min("timestamp").alias("first_sample"),
        F.max("timestamp").alias("last_sample"),
        *[f(F.coalesce(F.col(c), F.lit(0.0))).alias(f"{n}_{s}") for n, c in names.items() for s, f in stats.items()],
    )


def incident_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("incidents"))


def severity_rollup(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    s = F.upper("severity")
    return df.groupBy(*keys).agg(
        F.count_if(s == "CRITICAL").alias("critical"),
        F.count_if(s == "HIGH").alias("high"),
        F.count_if(~s.isin("CRITICAL", "HIGH")).alias("other"),
    )


def remediation_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total, successes, failures and the success rate in percent over the whole filter, 0 when empty."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        (ratio(F.count_if("success"), F.count("*")) * 100).alias("success_rate"),
    )


PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def percentile_index(df: DataFrame, value: str, keys: Sequence[str], last: int = 100, order: Sequence[Column] = ()) -> DataFrame:
    """Element int(n*p) of the sorted newest `last` values, rounded to 2 digits."""
    order = order or [F.desc("timestamp"), F.desc("id")]
    q = grouped_quantiles(last_n(df, keys, order, last), keys, value, PERCENTILES, "index", limit=None)
    return q.select(*keys, *[fixed(p, 2).alias(p) for p in PERCENTILES])


def percentile_linear(df: DataFrame, value: str, keys: Sequence[str], last: int | None = 1000, order: Sequence[Column] = ()) -> DataFrame:
    """Linearly interpolated percentiles and mean of the newest `last` values (of all when None)."""
    order = order or [F.desc("timestamp"), F.desc("id")]
    rows = df if last is None else last_n(df, keys, order, last)
    bounded = {} if last is None else {"limit": None}
    q = grouped_quantiles(rows, keys, value, PERCENTILES, **bounded)
    return q.join(rows.groupBy(*keys).agg(F.avg(value).alias("avg")), list(keys))


def error_rate(errors: Column | str, requests: Column | str) -> Column:
    return fixed(ratio(errors, requests), 4)


def state_rollup(df: DataFrame, state: str, maximum: int, keys: Sequence[str] = ()) -> DataFrame:
    """Connections by state beside the allowed maximum."""
    n = F.count("*")
    return df.groupBy(*keys).agg(
        n.alias("total_connections"),
        F.count_if(col(state) == "active").alias("active"),
        F.count_if(col(state) == "idle").alias("idle"),
        F.count_if(col(state) == "idle in transaction").alias("idle_in_transaction"),
        F.lit(maximum).alias("max_connections"),
        (F.lit(maximum) - n).alias("available"),
        fixed(n * 100.0 / maximum, 2).alias("utilization_percent"),
    )


def guarded_percent(part: Column | str, whole: Column | str, default: float) -> Column:
    """100 * part / whole to 2 digits, `default` when there is nothing to divide by."""
    w = col(whole)
    return F.when(w == 0, F.lit(float(default))).otherwise(fixed(F.try_divide(col(part) * 100.0, w), 2))


def classification_report(df: DataFrame, actual: Column, predicted: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, f1 and accuracy from one pass."""
    c = df.groupBy(*keys).agg(
        F.count_if(actual & predicted).alias("true_positives"),
        F.count_if(~actual & predicted).alias("false_positives"),
        F.count_if(~actual & ~predicted).alias("true_negatives"),
        F.count_if(actual & ~predicted).alias("false_negatives"),
        F.count("*").alias("total_samples"),
        F.count_if(actual).alias("total_anomalies"),
    )
    eps = F.lit(1e-6)
    tp, fp, tn, fn = (F.col(x) for x in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    return (
        c.withColumn("precision", tp / (tp + fp + eps))
        .withColumn("recall", tp / (tp + fn + eps))
        .withColumn("f1_score", F.lit(2) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))
        .withColumn("accuracy", F.try_divide((tp + tn).cast("double"), F.col("total_samples").cast("double")))
    )


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share of each label; the total is summed from the label counts, not from the rows again."""
    from pyspark.sql import Window

    counts = df.groupBy(label).agg(F.count("*").alias("rows"))
    everything = Window.partitionBy(F.lit(0))  # one row per label
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(everything))


def fit_errors(df: DataFrame, actual: str = "actual", fitted: str = "predicted_value", keys: Sequence[str] = ()) -> DataFrame:
    """n, rmse, mae, mean and sample deviation per series, over rows that have both values."""
    miss = F.col(fitted) - F.col(actual)
    return df.filter(F.col(actual).isNotNull() & F.col(fitted).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(F.abs(miss)).alias("mae"),
        F.avg(actual).alias("mean_value"),
        F.stddev_samp(actual).alias("std_value"),
    )


def evaluate_anomalies(sc, inc, as_of, hours=24, keys=()) -> DataFrame:
    """Share of anomalous scores that an incident confirms; each score counts once."""
    m = match_anomalies(sc.filter(F.col("timestamp") > before(as_of, hours=hours)), inc, keys)
    return m.agg(
        F.count("*").alias("total_predictions"),
        F.count_if("matched").alias("true_positives"),
        ratio(F.count_if("matched"), F.count("*")).alias("precision"),
    )


def evaluate_predictions(pr, inc, as_of, hours=24, keys=()) -> DataFrame:
    m = match_predictions(pr.filter(F.col("timestamp") > before(as_of, hours=hours)), inc, keys)
    return m.agg(
        F.count("*").alias("predictions"),
        F.count_if("matched").alias("correct"),
        ratio(F.count_if("matched"), F.count("*")).alias("accuracy"),
    )


def evaluate_fanout(counted: DataFrame, matches: str = "matches") -> DataFrame:
    """The same evaluation with one row per (prediction, incident) pair, from counts of matches."""
    rows = F.sum(F.greatest(F.col(matches), F.lit(1)))
    return counted.agg(
        F.coalesce(rows, F.lit(0)).alias("total"),
        F.coalesce(F.sum(matches), F.lit(0)).alias("hits"),
        ratio(F.sum(matches), rows).alias("rate"),
    )


def evaluate_forecasts(fc, actual, as_of, hours=24) -> DataFrame:
    m = match_forecasts(fc.filter(F.col("predicted_timestamp") > before(as_of, hours=hours)), actual)
    return m.agg(
        F.coalesce(F.avg(F.abs(F.col("predicted_value") - F.col("value"))), F.lit(0.0)).alias("mae"),
        F.count("*").alias("comparisons"),
    )


def evaluate_model(kind: str, **tables) -> DataFrame:
    """Performance of one kind of model over recent predictions."""
    kinds = {
        "anomaly_detector": evaluate_anomalies,
        "failure_predictor": evaluate_predictions,
        "forecaster": evaluate_forecasts,
    }
    return kinds[kind](**tables)


def score_stats(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population deviation and range of scores, with both verdict counts."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.avg("anomaly_score").alias("score_mean"),
        F.stddev_pop("anomaly_score").alias("score_std"),
        F.min("anomaly_score").alias("score_min"),
        F.max("anomaly_score").alias("score_max"),
        F.count_if("is_anomaly").alias("anomalies_detected"),
        F.count_if(~F.col("is_anomaly")).alias("normal_detected"),
    )


def mttr(inc: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean time to resolve, over resolved incidents, and the number of incidents."""
    done = F.when(F.col("status") == "RESOLVED", F.col("resolution_time_seconds"))
    return inc.groupBy(*by).agg(F.count("*").alias("incidents"), F.avg(done).alias("mttr_seconds"))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Cumulative buckets per key, with the +Inf bucket, the sum and the count."""
    wide = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count("*").alias("count"),
        F.sum(value).alias("sum"),
    )
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cum")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cum")))
    return wide.select(*keys, "count", "sum", F.inline(F.array(*rows)))


def histogram_quantile(df: DataFrame, q: float, keys: Sequence[str], le: str = "le", cum: str = "cum") -> DataFrame:
    """Quantile estimated from cumulative buckets: linear inside the first bucket that reaches the rank.

    A key has one row per bucket bound, so its buckets fit in one short sorted array."""
    buckets = F.array_sort(F.collect_list(F.struct(F.col(le).cast("double").alias("le"), F.col(cum).cast("double").alias("cum"))))
    g = df.groupBy(*keys, le).agg(F.sum(cum).alias(cum)).groupBy(*keys).agg(buckets.alias("_b"))
    g = g.withColumn("_rank", F.lit(q) * F.element_at("_b", -1)["cum"])
    g = g.withColumn("_i", F.size(F.filter("_b", lambda b: b["cum"] < F.col("_rank"))))
    here, prev = F.get("_b", F.col("_i")), F.get("_b", F.col("_i") - 1)
    lower = F.when(F.col("_i") == 0, 0.0).otherwise(prev["le"])
    below = F.when(F.col("_i") == 0, 0.0).otherwise(prev["cum"])
    inside = lower + (here["le"] - lower) * F.try_divide(F.col("_rank") - below, here["cum"] - below)
    value = (
        F.when(F.element_at("_b", -1)["cum"] == 0, F.lit(None))
        .when(here["le"] == float("inf"), lower)
        .otherwise(inside)
    )
    return g.select(*keys, value.alias("quantile"))


def vector_agg(df: DataFrame, op: str, by: Sequence[str], labels: str = "labels", value: str = "value") -> DataFrame:
    """sum, avg, min, max or count of samples by labels."""
    fn = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[op]
    return df.groupBy(*[F.col(labels)[k].alias(k) for k in by]).agg(fn(value).alias("value"))


def count_equal(df: DataFrame, x: float, value: str = "value") -> DataFrame:
    return df.agg(F.count_if(F.col(value) == x).alias("value"))


def vector_ratio(a: DataFrame, b: DataFrame, on: Sequence[str], scale: float = 1.0) -> DataFrame:
    """a / b of two series tables with equal labels, times `scale`; labels only one side has drop out."""
    both = a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), list(on))
    return both.select(*on, (F.try_divide(F.col("_a").cast("double"), F.col("_b").cast("double")) * scale).alias("value"))


# Name parts that put a feature column in a group.
FEATURE_GROUPS = {
    "time_features": ("hour", "day", "weekend"),
    "rolling_features": ("rolling",),
    "lag_features": ("lag",),
    "rate_features": ("diff", "pct_change"),
    "interaction_features": ("interaction",),
    "indicator_features": ("indicator",),
}


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows, features and features per group; the groups come from the schema alone."""
    groups = {g: sum(any(p in c for p in parts) for c in df.columns) for g, parts in FEATURE_GROUPS.items()}
    return df.agg(
        F.count("*").alias("total_samples"),
        F.lit(len(features)).alias("total_features"),
        *[F.lit(n).alias(g) for g, n in groups.items()],
    )
