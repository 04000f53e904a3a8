"""Models: invariants, planted outliers, persistence and the lifecycle."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import anomaly, failure, forecast, lifecycle
from fleetlens.operators import features as ft
from fleetlens.sources import tables as t


@pytest.fixture(scope="module")
def cloud(spark):
    """900 rows near the origin and five far away."""
    r = np.random.default_rng(3)
    rows = [(i, *map(float, r.normal(size=3))) for i in range(900)] + [(900 + i, *map(float, r.normal(9, 1, size=3))) for i in range(5)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double").withColumn("label", F.when(F.col("id") >= 900, "storm").otherwise("normal"))


@pytest.fixture(scope="module")
def forest(cloud):
    return anomaly.fit_isolation_forest(cloud, ["a", "b", "c"], ["id"])


def test_forest_finds_planted_outliers(cloud, forest):
    s = anomaly.score_isolation_forest(cloud, forest, ["id", "label"], contributions=True)
    ranked = [r["id"] for r in s.orderBy("anomaly_score").limit(5).collect()]
    assert sorted(ranked) == [900, 901, 902, 903, 904]
    facts = s.agg(F.min("anomaly_severity").alias("lo"), F.max("anomaly_severity").alias("hi"), F.avg(F.col("is_anomaly").cast("int")).alias("share")).first()
    assert 0 <= facts["lo"] and facts["hi"] <= 100 and abs(facts["share"] - 0.05) < 0.005
    assert s.filter("id = 900").first()["contributions"][0]["share"] <= 1
    assert forest.stats["anomalies_detected"] + forest.stats["normal_detected"] == 905
    rep = anomaly.evaluate(s).first()
    assert rep["true_positives"] == 5 and rep["total_samples"] == 905 and rep["recall"] > 0.99


def test_forest_is_repeatable_and_persists(spark, cloud, forest, tmp_path):
    again = anomaly.fit_isolation_forest(cloud.repartition(5), ["a", "b", "c"], ["id"])
    assert again.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(forest.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    anomaly.save_forest(spark, forest, str(tmp_path / "f"))
    loaded = anomaly.load_forest(spark, str(tmp_path / "f"))
    a = {r["id"]: r["anomaly_score"] for r in anomaly.score_isolation_forest(cloud, forest, ["id"]).collect()}
    b = {r["id"]: r["anomaly_score"] for r in anomaly.score_isolation_forest(cloud, loaded, ["id"]).collect()}
    assert a == b and anomaly.model_info(loaded)["n_features"] == 3


def test_forest_samples_are_bounded(spark):
    big = spark.range(40000).withColumn("x", F.array(F.col("id").cast("double")))
    s = anomaly._sample(big, ["id"], 40000, 100, 256, 42).groupBy("tree").count().collect()
    assert len(s) == 100 and all(r["count"] == 256 for r in s)


def test_forest_guards(cloud):
    with pytest.raises(ValueError):
        anomaly.fit_isolation_forest(cloud.limit(50), ["a"], ["id"])
    with pytest.raises(ValueError):
        anomaly.fit_isolation_forest(cloud, ["a"], ["id"], contamination=0.9)


def test_tree_isolates_extremes():
    x = np.concatenate([np.zeros((200, 1)) + np.linspace(0, 1, 200)[:, None], [[50.0]]])
    nodes = anomaly.grow(x, np.random.default_rng(1), 8)
    assert sum(n[6] for n in nodes if n[1] < 0) == 201 and max(n[5] for n in nodes) <= 8
    assert anomaly.mean_path(2) == 1 and anomaly.mean_path(1) == 0 and 10 < anomaly.mean_path(256) < 10.5


def test_latest_verdict(spark, small):
    rows = ft.extract_features(t.metrics_wide(spark, small))
    model = anomaly.fit_isolation_forest(rows, ft.feature_columns(rows), ["service_name", "timestamp"], trees=10)
    scored = anomaly.score_isolation_forest(rows, model, ["service_name", "timestamp"])
    assert anomaly.score_latest(scored).count() == 4


def test_forecast_follows_the_pattern(spark):
    """y = (100 + hours) * (1.5 in the morning, 1 else): the fit must come close."""
    h = F.col("id")
    ts = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=h.cast("int"))).alias("timestamp")
    y = (F.lit(100.0) + h / 10) * F.when((h % 24) < 12, 1.5).otherwise(1.0)
    long = spark.range(24 * 28).select(F.lit("s").alias("service"), F.lit("m").alias("metric_name"), ts, y.alias("value"))
    model = forecast.fit_forecaster(long.unionByName(long.limit(50).withColumn("metric_name", F.lit("short"))))
    assert model.count() == 1
    row = model.first()
    assert row["samples"] == 672 and row["mae"] < 3 and len(row["hour_factors"]) == 24 and len(row["day_factors"]) == 7
    fc = forecast.forecast(model, "2024-01-29 00:00:00", 24)
    assert fc.count() == 1440 and fc.filter("not (lower_bound <= forecast and forecast <= upper_bound)").isEmpty()
    got = fc.filter(F.minute("timestamp") == 0).orderBy("timestamp").collect()
    assert abs(got[3]["forecast"] - (100 + 67.5) * 1.5) < 8 and abs(got[20]["forecast"] - (100 + 69.2)) < 8
    with pytest.raises(ValueError):
        forecast.forecast(model, "2024-01-29", 25)


def test_failure_model(spark, small, tmp_path):
    long = t.metrics_long(spark, small)
    inc = t.incident_events(spark, small).filter(F.col("type") == "error").withColumnRenamed("service_name", "service")
    rows = failure.training_set(long, inc, "2024-01-31 00:00:00", t.LONG_METRICS, hours=744).cache()
    model = failure.fit_failure_model(rows, rounds=3)
    assert model.metrics["samples"] == rows.count() and 0.5 < model.metrics["train_accuracy"] <= 1
    out = failure.predict_failure(rows, model).collect()
    assert len(out) == 4 and all(0 <= r["failure_probability"] <= 1 and len(r["top_contributing_features"]) == 5 for r in out)
    failure.save_model(spark, model, str(tmp_path / "m"))
    again = failure.predict_failure(rows, failure.load_model(spark, str(tmp_path / "m"))).collect()
    assert sorted(r["failure_probability"] for r in again) == sorted(r["failure_probability"] for r in out)
    fitted = forecast.fit_forecaster(long, min_rows=10)
    hours = failure.predict_hours_from_forecast(model, long, forecast.forecast(fitted, "2024-01-31 01:00:00", 2), t.LONG_METRICS)
    assert hours.select("timestamp").distinct().count() == 2
    with pytest.raises(ValueError):
        failure.predict_hours(rows, "2024-01-31", 73)


def test_lifecycle(spark):
    reg = spark.createDataFrame([(1, "forecaster", "2024-01-01 00:00:00", None, 25.0), (2, "anomaly_detector", "2024-01-01 00:00:00", 0.6, None)], "id int, model_name string, at string, accuracy double, mae double")
    reg = reg.withColumn("trained_at", F.col("at").cast("timestamp_ntz"))
    log = spark.createDataFrame([("anomaly_detector", "2024-01-01 01:00:00")], "model_name string, at string").select("model_name", F.col("at").cast("timestamp_ntz").alias("timestamp"))
    got = {r["model_name"]: r["retrain_reason"] for r in lifecycle.model_status(reg, log, "2024-01-01 06:00:00").collect()}
    assert got["failure_predictor"] == "Model never trained"
    assert got["forecaster"] == "Performance degraded (MAE: 25.00)"
    assert got["anomaly_detector"] == "Performance degraded (accuracy: 60.00%)"
    status = lifecycle.model_status(reg, log, "2024-01-01 06:00:00")

    def fails():
        raise ValueError("no data")

    report = lifecycle.retrain_cycle(status, {"forecaster": lambda: {}, "failure_predictor": fails})
    assert {r["model"]: r["status"] for r in report} == {"forecaster": "success", "failure_predictor": "failed"}
    assert lifecycle.cycle_summary(report) == {"total": 2, "successful": 1}
    runs = spark.createDataFrame([("cleanup", "2024-01-01 00:00:00")], "job string, at string").select("job", F.col("at").cast("timestamp_ntz").alias("started_at"))
    due = {r["job"]: r["due"] for r in lifecycle.due_jobs(runs, "2024-01-01 12:00:00").collect()}
    assert due == {"cleanup": False, "failure_check": True, "retrain_check": True}


def test_sample_bound_does_not_vanish():
    """A share far below one in a million keeps a threshold of its own."""
    from fleetlens.operators.anomaly import sample_bound

    assert sample_bound(1.0) == 2**63 - 1
    share = 2 * 256 * 100 / 1e10  # of 1e10 rows
    assert abs((sample_bound(share) + 2**63) / 2**64 / share - 1) < 1e-6


def test_every_tree_is_full(spark):
    from fleetlens.operators.anomaly import _sample

    rows = spark.range(20_000).select("id", F.array(F.col("id").cast("double")).alias("x"))
    for psi, trees in ((64, 100), (256, 10), (5000, 3)):
        got = _sample(rows, ["id"], 20_000, trees, psi, 1).groupBy("tree").count().collect()
        assert len(got) == trees and {r["count"] for r in got} == {psi}


def test_registered_prediction_trains_every_round(spark, small, monkeypatch):
    """K18 has 100 rounds; two stand for them here, to save time."""
    from fleetlens.catalog import models

    real, asked = failure.fit_failure_model, []

    def spy(*args, **kwargs):
        call = inspect.signature(real).bind(*args, **kwargs)
        call.apply_defaults()
        asked.append(call.arguments["rounds"])
        call.arguments["rounds"] = 2
        return real(*call.args, **call.kwargs)

    monkeypatch.setattr(failure, "fit_failure_model", spy)
    assert models.k19(spark, small).count() == 4
    assert asked == [100]


def test_retrain_cycle_trains_and_registers_all_models(spark, small, monkeypatch):
    from fleetlens.catalog import models

    real = failure.fit_failure_model
    monkeypatch.setattr(failure, "fit_failure_model", lambda df: real(df, rounds=2))
    status = lifecycle.model_status(t.registry(spark, small), models._log(spark, small), "2001-08-03 12:00:00")
    due = {r["model_name"] for r in status.filter("should_retrain").collect()}
    rows = {r["model"]: r for r in models.k22(spark, small).collect()}
    assert set(rows) == set(t.MODELS) and due == set(t.MODELS)
    runs = {r["model_name"]: r["count"] for r in t.registry(spark, small).groupBy("model_name").count().collect()}
    for name in ("anomaly_detector", "failure_predictor"):
        assert rows[name]["status"] == "success" and 0 < rows[name]["accuracy"] <= 1
        assert rows[name]["version"] == runs[name] + 1 and rows[name]["model_type"] == lifecycle.MODEL_TYPES[name]
    # The smallest data has no series of 100 points, so nothing is registered for it.
    assert rows["forecaster"]["status"] == "failed" and rows["forecaster"]["version"] is None


def test_retrain_cycle_reports_models_without_trainer(spark, small):
    from fleetlens.catalog import models

    status = lifecycle.model_status(t.registry(spark, small), models._log(spark, small), "2001-08-03 12:00:00")
    report = lifecycle.retrain_cycle(status, {"forecaster": lambda: {"mae": 1.0}}, every=True)
    assert {r["model"]: r["status"] for r in report} == {"anomaly_detector": "skipped", "failure_predictor": "skipped", "forecaster": "success"}


def test_registry_grows_by_cycles(spark, tmp_path):
    """A stored cycle raises the version; repeated, it adds nothing."""
    from fleetlens.sources.partitions import read_table

    path, first = str(tmp_path / "registry"), spark.createDataFrame([(1, "forecaster", "2001-08-01 00:00:00")], "id long, model_name string, trained_at string")
    reg = first.withColumn("trained_at", F.col("trained_at").cast("timestamp_ntz"))
    report = [{"model": "forecaster", "status": "success", "reason": "due", "result": {"mae": 1.5, "series": 3}}, {"model": "failure_predictor", "status": "failed", "reason": "no"}]
    for now, version in (("2001-08-03 12:00:00", 2), ("2001-08-04 12:00:00", 3)):
        rows = lifecycle.registry_rows(reg, report, now)
        for _ in range(2):
            lifecycle.append_registry(rows, path, now)
        stored = read_table(spark, path)
        assert stored.count() == version - 1 and stored.agg(F.max("version")).first()[0] == version
        reg = stored


def test_errors_of_a_series_are_spread_over_its_cells(spark):
    """The join of the second pass goes by cell and no row carries the maps of a model (they would have to be sorted); rows
    without a time count as before."""
    long = spark.range(2000).select(
        F.lit("a").alias("service"), F.lit("m").alias("metric_name"), (F.col("id") % 37 + F.col("id") / 100).alias("value"),
        F.when(F.col("id") % 50 > 0, F.timestamp_seconds(1704067200 + F.col("id") * 1800)).alias("timestamp"),
    )
    fitted = forecast.fit_forecaster(long)
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "_h" in plan
    m = fitted.first()
    miss = F.col("p") - F.col("value")
    rows = long.join(fitted.drop("samples"), ["service", "metric_name"]).withColumn("p", forecast.predict("timestamp"))
    want = rows.agg(F.stddev_pop(miss), F.sqrt(F.avg(miss * miss)), F.avg(F.abs(miss)), F.avg("value"), F.stddev_samp("value")).first()
    assert m["samples"] == 2000
    assert [m[c] for c in ("sd", "rmse", "mae", "mean_value", "std_value")] == pytest.approx(list(want))
