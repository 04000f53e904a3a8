"""Failure prediction: boosted trees on long metrics labelled by what happens in the next hour."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.dates import after, before
from fleetlens.operators.features import assemble, failure_features
from fleetlens.operators.filters import require_rows
from fleetlens.operators.joins import label_next_hour
from fleetlens.operators.rules import risk_level, risk_message
from fleetlens.operators.windows import latest_row

KEYS = ("service",)


@dataclass
class FailureModel:
    features: list[str]
    model: GBTClassificationModel
    metrics: dict

    def importances(self) -> list[tuple[str, float]]:
        """Features by importance, largest first."""
        pairs = zip(self.features, self.model.featureImportances.toArray().tolist())
        return sorted(pairs, key=lambda p: (-p[1], p[0]))


def training_set(long: DataFrame, inc: DataFrame, as_of, metrics: Sequence[str], hours: float = 168, keys: Sequence[str] = KEYS) -> DataFrame:
    """Features of the last `hours` with label 1 where an incident follows within an hour."""
    since = before(as_of, hours=hours)
    feats = failure_features(long.filter(F.col("timestamp") > since), metrics, keys)
    return label_next_hour(feats, inc.filter(F.col("timestamp") > since), 1, keys)


def feature_names(df: DataFrame, keys: Sequence[str] = KEYS) -> list[str]:
    return [c for c in df.columns if c not in (*keys, "timestamp", "label")]


def fit_failure_model(df: DataFrame, rounds: int = 100, seed: int = 42, keys: Sequence[str] = KEYS, **params) -> FailureModel:
    """Train on a labelled set. Both labels must occur."""
    require_rows(df, 10)
    features = feature_names(df, keys)
    ready = assemble(df.withColumn("label", F.col("label").cast("double")), features)
    # The settings of the classifier.
    gbt = GBTClassifier(
        maxIter=rounds, stepSize=0.05, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.9",
        minInstancesPerNode=20, seed=seed, **params,
    )
    model = gbt.fit(ready)
    scored = model.transform(ready)
    facts = scored.agg(
        F.count("*").alias("samples"),
        F.sum("label").cast("long").alias("positive_samples"),
        F.avg("label").alias("positive_ratio"),
        F.avg(F.when((vector_to_array("probability")[1] >= 0.5) == (F.col("label") == 1), 1.0).otherwise(0.0)).alias("train_accuracy"),
    ).first().asDict()
    out = FailureModel(features, model, facts)
    out.metrics |= {"num_features": len(features), "top_features": out.importances()[:5]}
    return out


def predict_failure(features: DataFrame, fitted: FailureModel, keys: Sequence[str] = KEYS, k: int = 5) -> DataFrame:
    """Probability, risk and main features for the newest row of each key."""
    newest = latest_row(features, keys, ["timestamp"], {c: c for c in ("timestamp", *fitted.features)})
    out = fitted.model.transform(assemble(newest, fitted.features))
    out = out.withColumn("failure_probability", vector_to_array("probability")[1])
    out = out.withColumn("risk_level", risk_level("failure_probability"))
    out = out.withColumn("message", risk_message("risk_level"))
    return top_contributors(out, fitted, k).select(
        *keys, "timestamp", "failure_probability", "risk_level", "message", "top_contributing_features"
    )


def top_contributors(df: DataFrame, fitted: FailureModel, k: int = 5) -> DataFrame:
    """The k most important features with their values. The order is the model's, so it is known here."""
    parts = [
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.lit(w).alias("importance"))
        for f, w in fitted.importances()[:k]
    ]
    return df.withColumn("top_contributing_features", F.array(*parts))


def predict_hours(pred: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """The prediction repeated for each of the next hours."""
    if not 1 <= hours <= 72:
        raise ValueError("hours must be between 1 and 72")
    grid = pred.withColumn("hour_ahead", F.explode(F.sequence(F.lit(1), F.lit(hours))))
    return grid.withColumn("predicted_for", after(as_of) + F.make_dt_interval(hours=F.col("hour_ahead")))


def predict_hours_from_forecast(model: FailureModel, long: DataFrame, fc: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Risk of every forecast hour: forecast hourly means continue the measured history."""
    ahead = fc.groupBy(*keys, "metric_name", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp")).agg(
        F.avg("forecast").alias("value")
    )
    known = long.select(*keys, "metric_name", "timestamp", "value").withColumn("_ahead", F.lit(False))
    both = known.unionByName(ahead.withColumn("_ahead", F.lit(True)))
    feats = failure_features(both, metrics, keys)
    times = ahead.select(*keys, "timestamp").distinct()
    out = model.model.transform(assemble(feats.join(times, [*keys, "timestamp"], "left_semi"), model.features))
    out = out.withColumn("failure_probability", vector_to_array("probability")[1])
    return out.select(*keys, "timestamp", "failure_probability", risk_level("failure_probability").alias("risk_level"))


def save_model(spark: SparkSession, fitted: FailureModel, path: str) -> None:
    fitted.model.write().overwrite().save(f"{path}/model")
    names = list(enumerate(fitted.features))
    spark.createDataFrame(names, "position int, feature string").write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> FailureModel:
    names = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("position").collect()]
    return FailureModel(names, GBTClassificationModel.load(f"{path}/model"), {})


def model_info(fitted: FailureModel) -> dict:
    return {**fitted.metrics, "feature_names": fitted.features[:10]}
