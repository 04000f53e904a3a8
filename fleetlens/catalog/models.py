"""Queries for scoring, forecasting, failure prediction and model lifecycle (inventory groups I6, I11, J10, K5 to K24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import R, query
from fleetlens.functions.numeric import fixed
from fleetlens.operators import anomaly, failure, forecast, lifecycle, rules
from fleetlens.operators import features as ft
from fleetlens.session import durable
from fleetlens.sources import tables as t

KEY = ["service_name", "timestamp"]
EV_NOW = "2024-01-31 00:00:00"
INC_NOW = "2001-08-01 00:00:00"


def _r(df, *cols, digits=4):
    return df.withColumns({c: fixed(c, digits) for c in cols})


def _feature_rows(spark, p):
    """Feature rows with a label: an hour with errors is not normal."""
    m = t.metrics_wide(spark, p).withColumn("label", F.when(F.col("error_rate") > 0.4, "error_storm_active").otherwise("normal"))
    return ft.extract_features(m)


@query("k5_k6_isolation_forest")
def k6(spark, p):
    """Train on all feature rows and score them."""
    rows = _feature_rows(spark, p)
    model = anomaly.fit_isolation_forest(rows, ft.feature_columns(rows), KEY)
    return anomaly.score_isolation_forest(rows, model, KEY)


@query("k8_evaluate")
def k8(spark, p):
    rows = _feature_rows(spark, p)
    model = anomaly.fit_isolation_forest(rows, ft.feature_columns(rows), KEY)
    return anomaly.evaluate(anomaly.score_isolation_forest(rows, model, [*KEY, "label"]))


@query("k6_severity", f"select id, {R('greatest(0.0, least(100.0, 50 - 20*(anomaly_score - (select avg(anomaly_score) from scores))/((select stddev_pop(anomaly_score) from scores) + 1e-6)))')} as severity from scores")
def k6_severity(spark, p):
    s = t.scores(spark, p)
    st = s.agg(F.avg("anomaly_score").alias("m"), F.stddev_pop("anomaly_score").alias("d")).first()
    return s.select("id", fixed(anomaly.severity("anomaly_score", st["m"], st["d"])).alias("severity"))


@query("k9_tune_threshold", f"""with q as (select unnest(quantile_cont(anomaly_score, {[i / 99 for i in range(100)]})) as t, unnest(range(0, 100)) as i from scores),
 c as (select q.i, q.t, (select count(*) from scores s where s.label = 'normal' and s.anomaly_score < q.t)/(select count(*) from scores where label = 'normal') as fpr from q)
select {R("t", 6)} as threshold, {R("fpr")} as fpr from c order by abs(fpr - 0.05), i limit 1""")
def k9(spark, p):
    out = anomaly.tune_threshold(t.scores(spark, p))
    return out.select(fixed("threshold", 6).alias("threshold"), fixed("fpr").alias("fpr"))


_EH = "(epoch_us(timestamp)/3.6e9)"
_FIT = f"""tr as (select service, metric_name, count(*) as samples, coalesce(regr_slope(value, {_EH}), 0) as slope, avg(value) - coalesce(regr_slope(value, {_EH}), 0)*avg({_EH}) as intercept
   from metrics_long group by 1, 2 having count(*) >= 100),
 x as (select m.*, hour(timestamp) as h, isodow(timestamp) - 1 as d, tr.intercept + tr.slope*{_EH} as t from metrics_long m join tr using (service, metric_name)),
 hf as (select service, metric_name, h, sum(value)/sum(t) as f from x group by 1, 2, 3),
 df as (select x.service, x.metric_name, x.d, sum(value)/sum(t*hf.f) as f from x join hf using (service, metric_name, h) group by 1, 2, 3),
 fit as (select x.service, x.metric_name, x.value, x.t*hf.f*df.f as fitted from x join hf using (service, metric_name, h) join df using (service, metric_name, d)),
 er as (select service, metric_name, stddev_pop(value - fitted) as sd, sqrt(avg((value - fitted)*(value - fitted))) as rmse, avg(abs(value - fitted)) as mae from fit group by 1, 2)"""


def _fc(minutes, extra):
    return f"""with {_FIT},
 g as (select tr.*, timestamp '2024-01-31 00:00:00' + to_minutes(k) as timestamp from tr, range(0, {minutes}) r(k)),
 fc as (select g.service, g.metric_name, g.timestamp, (g.intercept + g.slope*{_EH.replace('timestamp', 'g.timestamp')})*coalesce(hf.f, 1)*coalesce(df.f, 1) as forecast, er.sd from g
   left join hf on hf.service = g.service and hf.metric_name = g.metric_name and hf.h = hour(g.timestamp)
   left join df on df.service = g.service and df.metric_name = g.metric_name and df.d = isodow(g.timestamp) - 1
   join er on er.service = g.service and er.metric_name = g.metric_name)
{extra}"""


def _model(spark, p):
    return forecast.fit_forecaster(t.metrics_long(spark, p))


@query("k11_fit_forecaster", f"with {_FIT} select tr.service, tr.metric_name, tr.samples, {R('slope', 6)} as slope, {R('er.sd')} as sd, {R('er.rmse')} as rmse, {R('er.mae')} as mae from tr join er using (service, metric_name)")
def k11(spark, p):
    m = _r(_model(spark, p), "sd", "rmse", "mae")
    return m.select("service", "metric_name", "samples", fixed("slope", 6).alias("slope"), "sd", "rmse", "mae")


@query("k12_forecast", _fc(180, f"select service, metric_name, timestamp, {R('forecast')} as forecast, {R('forecast - 1.96*sd')} as lower_bound, {R('forecast + 1.96*sd')} as upper_bound from fc"))
def k12(spark, p):
    return _r(forecast.forecast(_model(spark, p), EV_NOW, 3), "forecast", "lower_bound", "upper_bound")


_NH = """nh as (select service, metric_name, avg(forecast) as mean_forecast, max(forecast) as max_forecast, avg(forecast - 1.96*sd) as lower_bound, avg(forecast + 1.96*sd) as upper_bound,
  case when max_by(forecast, timestamp) > min_by(forecast, timestamp) then 'increasing' else 'decreasing' end as trend from fc group by 1, 2)"""


@query("k13_next_hour", _fc(60, f", {_NH} select service, metric_name, {R('mean_forecast')} as mean_forecast, {R('max_forecast')} as max_forecast, {R('lower_bound')} as lower_bound, {R('upper_bound')} as upper_bound, trend from nh"))
def k13(spark, p):
    nh = forecast.next_hour(forecast.forecast(_model(spark, p), EV_NOW, 1))
    return _r(nh, "mean_forecast", "max_forecast", "lower_bound", "upper_bound")


_LIMITS = {"cpu_usage": 20.0, "memory_usage": 25.0, "error_rate": 30.0}
_TH = " ".join(f"when '{m}' then {v}" for m, v in _LIMITS.items())


@query("k14_breach_alerts", _fc(60, f", {_NH}, b as (select *, case metric_name {_TH} end as threshold from nh) select service, metric_name as metric, case when mean_forecast > threshold*1.2 then 'CRITICAL' else 'WARNING' end as severity, {R('mean_forecast')} as predicted_value, threshold::double as threshold from b where mean_forecast > threshold"))
def k14(spark, p):
    nh = forecast.next_hour(forecast.forecast(_model(spark, p), EV_NOW, 1))
    return _r(forecast.breach_alerts(nh, _LIMITS), "predicted_value").select("service", "metric", "severity", "predicted_value", "threshold")


@query("i6_predicted_breach", _fc(60, f""", {_NH}, b as (select *, case metric_name {_TH} end as threshold from nh),
 w as (select *, row_number() over (partition by service order by mean_forecast desc, metric_name desc) as rn from b where mean_forecast > threshold)
select service, 'predicted_breach' as type, case when mean_forecast > threshold*1.2 then 'CRITICAL' else 'WARNING' end as severity, metric_name as metric from w where rn = 1"""))
def i6(spark, p):
    nh = forecast.next_hour(forecast.forecast(_model(spark, p), EV_NOW, 1))
    out = rules.predicted_breach(forecast.breach_alerts(nh, _LIMITS), ["service"])
    return out.select("service", "type", "severity", F.get_json_object("details", "$.metric").alias("metric"))


@query("f3_most_severe", _fc(60, f""", {_NH}, b as (select *, case metric_name {_TH} end as threshold from nh)
select service, max_by(metric_name, mean_forecast) as metric, {R('max(mean_forecast)')} as predicted_value from b where mean_forecast > threshold group by 1"""))
def f3(spark, p):
    nh = forecast.next_hour(forecast.forecast(_model(spark, p), EV_NOW, 1))
    worst = rules.most_severe(forecast.breach_alerts(nh, _LIMITS), ["service"])
    return _r(worst.select("service", "metric", "predicted_value"), "predicted_value")


@query("k15_trend", _fc(1440, f""", e as (select service, metric_name, min_by(forecast, timestamp) as a, max_by(forecast, timestamp) as b, stddev_samp(forecast) as v from fc group by 1, 2),
 c as (select *, b - a as change, case when a = 0 then 0 else (b - a)/a*100 end as pct from e)
select service, metric_name, {R('a')} as current_forecast, {R('b')} as final_forecast, {R('v')} as volatility, {R('change')} as change, {R('pct')} as percent_change,
 case when abs(pct) < 5 then 'stable' when pct > 0 then 'increasing' else 'decreasing' end as trend from c"""))
def k15(spark, p):
    out = forecast.trend(forecast.forecast(_model(spark, p), EV_NOW, 24))
    return _r(out, "current_forecast", "final_forecast", "volatility", "change", "percent_change")


def _failures(spark, p):
    return t.failures(spark, p).withColumnRenamed("service_name", "service")


@query("k17_training_set", """select m.service, m.timestamp, cast(exists (select 1 from failures i where i.service_name = m.service
   and i.timestamp > timestamp '2024-01-31' - interval 168 hour and i.timestamp between m.timestamp and m.timestamp + interval 1 hour) as int) as label
 from (select distinct service, timestamp from metrics_long where timestamp > timestamp '2024-01-31' - interval 168 hour) m""")
def k17(spark, p):
    out = failure.training_set(t.metrics_long(spark, p), _failures(spark, p), EV_NOW, t.LONG_METRICS)
    return out.select("service", "timestamp", "label")


def _fitted(spark, p):
    # Boosting reads its rows many times.
    rows = durable(failure.training_set(t.metrics_long(spark, p), _failures(spark, p), EV_NOW, t.LONG_METRICS, hours=744))
    return rows, failure.fit_failure_model(rows)


@query("k18_k20_failure_prediction")
def k19(spark, p):
    rows, model = _fitted(spark, p)
    out = failure.predict_failure(rows, model)
    return out.select("service", "timestamp", "failure_probability", "risk_level", F.transform("top_contributing_features", lambda c: c["feature"]).alias("top_features"))


@query("k21_predict_hours", """select id, failure_probability, k as hour_ahead, timestamp '2024-01-31 00:00:00' + to_hours(k) as predicted_for from predictions, range(1, 7) r(k)""")
def k21(spark, p):
    return failure.predict_hours(t.predictions(spark, p), EV_NOW, 6).select("id", "failure_probability", "hour_ahead", "predicted_for")


@query("f2_top_contributors", f"""with a as (select service_name, timestamp, abs(cpu_usage_percent) as c, abs(memory_usage_percent) as m, abs(error_rate) as e from metrics_wide),
 l as (select service_name, timestamp, c + m + e as total, unnest([{{'f': 'cpu_usage_percent', 'v': c}}, {{'f': 'memory_usage_percent', 'v': m}}, {{'f': 'error_rate', 'v': e}}]) as x from a)
select service_name, timestamp, string_agg(x.f, '|' order by x.v desc, x.f) filter (rn <= 2) as top_features from
 (select *, row_number() over (partition by service_name, timestamp order by x.v desc, x.f) as rn from l) q group by 1, 2""")
def f2(spark, p):
    cols = ["cpu_usage_percent", "memory_usage_percent", "error_rate"]
    c = ft.contributions(t.metrics_wide(spark, p), cols)
    names = F.transform(ft.top_k("contributions", 2), lambda x: x["feature"])
    return c.select(*KEY, F.array_join(names, "|").alias("top_features"))


# ---- lifecycle ------------------------------------------------------------------------------------

def _log(spark, p):
    """A prediction log: every line item is a prediction of one of the three models."""
    k = F.col("l_partkey") % 3
    name = F.when(k == 0, t.MODELS[0]).when(k == 1, t.MODELS[1]).otherwise(t.MODELS[2])
    return t.table(spark, p, "lineitem").select(name.alias("model_name"), F.col("l_shipdate").alias("timestamp"))


_STATUS = """last as (select model_name, max(trained_at) as last_trained, max_by(accuracy, struct_pack(a := trained_at, b := id)) as accuracy from registry where trained_at <= timestamp '{now}' group by 1),
 lg as (select case l_partkey % 3 when 0 then 'anomaly_detector' when 1 then 'failure_predictor' else 'forecaster' end as model_name, l_shipdate as ts from lineitem),
 st as (select last.*, (select count(*) from lg where lg.model_name = last.model_name and lg.ts > last.last_trained) as predictions_since_train from last)"""
_DECIDE = """case when (epoch(timestamp '{now}') - epoch(last_trained))/3600.0 >= 24 then 'Scheduled retrain (' || printf('%.1f', (epoch(timestamp '{now}') - epoch(last_trained))/3600.0) || ' hours since last training)'
   when predictions_since_train >= 100 then 'Sufficient new data (' || predictions_since_train || ' predictions)' else 'No retrain needed' end"""


@query("i11_should_retrain", f"with {_STATUS.format(now='2001-08-03 12:00:00')} select model_name, {_DECIDE.format(now='2001-08-03 12:00:00')} as retrain_reason from st")
def i11(spark, p):
    return lifecycle.model_status(t.registry(spark, p), _log(spark, p), "2001-08-03 12:00:00").select("model_name", "retrain_reason")


@query("k23_model_status", f"with {_STATUS.format(now='1999-06-01 06:00:00')} select model_name, last_trained, {R('accuracy')} as accuracy, predictions_since_train, {_DECIDE.format(now='1999-06-01 06:00:00')} <> 'No retrain needed' as should_retrain from st")
def k23(spark, p):
    out = lifecycle.model_status(t.registry(spark, p), _log(spark, p), "1999-06-01 06:00:00")
    return _r(out, "accuracy").select("model_name", "last_trained", "accuracy", "predictions_since_train", "should_retrain")


@query("j10_due_jobs", """with k as (select distinct affected_service from incidents), j as (select * from (values ('cleanup', 86400), ('failure_check', 300), ('cpu_spike', 864000)) v(job, every_s)),
 l as (select affected_service, case type when 'health_check_failed' then 'cleanup' else type end as job, max(timestamp) as last_run from incidents where timestamp <= timestamp '2001-08-01' group by 1, 2)
select k.affected_service, j.job, l.last_run, l.last_run is null or epoch(timestamp '2001-08-01') - epoch(l.last_run) >= j.every_s as due from k cross join j left join l on l.affected_service = k.affected_service and l.job = j.job""")
def j10(spark, p):
    runs = t.incidents(spark, p).select(
        "affected_service", F.when(F.col("type") == "health_check_failed", "cleanup").otherwise(F.col("type")).alias("job"), F.col("timestamp").alias("started_at")
    )
    every = {"cleanup": 86400, "failure_check": 300, "cpu_spike": 864000}
    return lifecycle.due_jobs(runs, INC_NOW, every, ["affected_service"]).select("affected_service", "job", "last_run", "due")


def _train_forest(spark, p):
    rows = _feature_rows(spark, p)
    model = anomaly.fit_isolation_forest(rows, ft.feature_columns(rows), KEY)
    scored = anomaly.score_isolation_forest(rows, model, [*KEY, "label"])
    return model.stats | {"accuracy": anomaly.evaluate(scored).first()["accuracy"]}


def _train_trees(spark, p):
    facts = _fitted(spark, p)[1].metrics
    return facts | {"accuracy": facts["train_accuracy"]}


def _train_forecaster(spark, p):
    facts = _model(spark, p).agg(F.count("*").alias("series"), F.avg("mae").alias("mae")).first().asDict()
    if not facts["series"]:
        raise ValueError("no series has enough samples")
    return facts


@query("k22_retrain_cycle")
def k22(spark, p):
    """Decide for every model, train those due, and return the registry rows of the cycle."""
    now, reg = "2001-08-03 12:00:00", t.registry(spark, p)
    trainers = {
        "anomaly_detector": lambda: _train_forest(spark, p),
        "failure_predictor": lambda: _train_trees(spark, p),
        "forecaster": lambda: _train_forecaster(spark, p),
    }
    report = lifecycle.retrain_cycle(lifecycle.model_status(reg, _log(spark, p), now), trainers, every=True)
    return lifecycle.registry_rows(reg, report, now)
