"""Forecasts per series: a linear trend times an hour-of-day factor times a weekday factor.

The fit reads the rows twice for any number of series; the model is one row per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.dates import moment
from fleetlens.schemas import FORECAST_THRESHOLDS

SERIES = ("service", "metric_name")
Z95 = 1.96


def epoch_hours(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / F.lit(3.6e9)


def _trend(ts="timestamp"):
    return F.col("intercept") + F.col("slope") * epoch_hours(ts)


def _total(cells: Column, value) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + value(c))


def fit_forecaster(long: DataFrame, metrics: Sequence[str] | None = None, keys: Sequence[str] = SERIES, min_rows: int = 100) -> DataFrame:
    """One model row per series with at least `min_rows` values: slope, intercept, the factors of the 24
    hours and 7 weekdays, the spread of what is left, and the fit errors.

    The rows are read twice. The first pass leaves at most 168 cells (hour, weekday) per series with their
    moments, from which the whole model follows; the second measures the errors. There a row meets its cell, which has
    the four numbers that its forecast takes: a series is spread over its cells, and rows carry no whole model."""
    rows = long.filter(F.col("value").isNotNull())
    if metrics is not None:
        rows = rows.filter(F.col("metric_name").isin(list(metrics)))
    rows = rows.select(*keys, "timestamp", "value", F.hour("timestamp").alias("h"), F.weekday("timestamp").alias("d"))
    x, y, on = epoch_hours("timestamp"), F.col("value"), list(keys)
    n = F.count("*")
    cells = rows.groupBy(*on, "h", "d").agg(
        n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        (F.var_pop(x) * n).alias("sxx"), (F.covar_pop(x, y) * n).alias("sxy"),
    )
    series = cells.groupBy(*on).agg(
        F.sum("n").alias("samples"),
        (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("_mx"),
        (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("_my"),
        F.collect_list(F.struct("h", "d", "n", "mx", "my", "sxx", "sxy")).alias("_c"),
    ).filter(F.col("samples") >= min_rows)
    c, mx, my = F.col("_c"), F.col("_mx"), F.col("_my")
    sxx = _total(c, lambda e: e["sxx"] + e["n"] * (e["mx"] - mx) * (e["mx"] - mx))
    sxy = _total(c, lambda e: e["sxy"] + e["n"] * (e["mx"] - mx) * (e["my"] - my))
    line = series.withColumn("slope", F.coalesce(F.try_divide(sxy, sxx), F.lit(0.0))).withColumn(
        "intercept", my - F.col("slope") * mx
    )

    def trend_sum(e):
        return e["n"] * (F.col("intercept") + F.col("slope") * e["mx"])

    def factors(size, field, base):
        """Measured over modelled total of each hour or weekday that occurs."""
        def one(i):
            mine = F.filter(c, lambda e: e[field] == i)
            share = F.try_divide(_total(mine, lambda e: e["n"] * e["my"]), _total(mine, base))
            return F.struct(i.alias("k"), F.when(F.size(mine) > 0, F.coalesce(share, F.lit(1.0))).alias("v"))

        entries = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)
        return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))

    hourly = line.withColumn("hour_factors", factors(24, "h", trend_sum))
    model = hourly.withColumn("day_factors", factors(7, "d", lambda e: trend_sum(e) * F.col("hour_factors")[e["h"]]))
    def factor(kind, field):
        return F.coalesce(F.col(f"{kind}_factors")[F.col(f"_c.{field}")], F.lit(1.0))

    # Rows without a time have a cell, too.
    of = [F.coalesce(F.col(c), F.lit(-1)) for c in ("h", "d")]
    spots = model.withColumn("_c", F.explode("_c")).select(*on, "slope", "intercept", factor("hour", "h").alias("_hour"), factor("day", "d").alias("_day"), *[F.coalesce(F.col(f"_c.{c}"), F.lit(-1)).alias(f"_{c}") for c in ("h", "d")])
    miss = _trend() * F.col("_hour") * F.col("_day") - y
    placed = rows.select(*on, "timestamp", "value", of[0].alias("_h"), of[1].alias("_d")).join(spots, [*on, "_h", "_d"])
    errors = placed.groupBy(*on).agg(
        F.stddev_pop(miss).alias("sd"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(F.abs(miss)).alias("mae"),
        F.avg(y).alias("mean_value"),
        F.stddev_samp(y).alias("std_value"),
    )
    fields = ("samples", "slope", "intercept", "hour_factors", "day_factors")
    return model.select(*on, *fields).join(errors, on)


def predict(ts: Column | str) -> Column:
    """Model value at a time, from the columns of a model row."""
    c = F.col(ts) if isinstance(ts, str) else ts
    hour = F.coalesce(F.col("hour_factors")[F.hour(c)], F.lit(1.0))
    day = F.coalesce(F.col("day_factors")[F.weekday(c)], F.lit(1.0))
    return _trend(c) * hour * day


def forecast(model: DataFrame, as_of, hours: int = 6, metric: str | None = None, keys: Sequence[str] = SERIES) -> DataFrame:
    """One point a minute from `as_of`, with a 95 % band."""
    if not 1 <= hours <= 24:
        raise ValueError("hours must be between 1 and 24")
    m = model if metric is None else model.filter(F.col("metric_name") == metric)
    grid = m.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(hours * 60 - 1))))
    grid = grid.withColumn("timestamp", moment(as_of) + F.make_dt_interval(mins=F.col("_k")))
    grid = grid.withColumn("forecast", predict("timestamp"))
    band = F.lit(Z95) * F.col("sd")
    return grid.select(
        *keys, "timestamp", "forecast", (F.col("forecast") - band).alias("lower_bound"), (F.col("forecast") + band).alias("upper_bound")
    )


def _ends(column="forecast"):
    return F.min_by(column, "timestamp"), F.max_by(column, "timestamp")


def next_hour(fc: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Mean, maximum, mean band and direction of a one-hour forecast."""
    first, last = _ends()
    return fc.groupBy(*keys).agg(
        F.avg("forecast").alias("mean_forecast"),
        F.max("forecast").alias("max_forecast"),
        F.avg("lower_bound").alias("lower_bound"),
        F.avg("upper_bound").alias("upper_bound"),
        F.when(last > first, "increasing").otherwise("decreasing").alias("trend"),
    )


def breach_alerts(nh: DataFrame, thresholds: dict[str, float] | None = None, keys: Sequence[str] = SERIES) -> DataFrame:
    """Series whose mean forecast exceeds the limit of their metric; metrics without a limit are skipped."""
    limits = FORECAST_THRESHOLDS if thresholds is None else thresholds
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in (kv[0], float(kv[1]))])
    limit, mean = table[F.col("metric_name")], F.col("mean_forecast")
    rest = [k for k in keys if k != "metric_name"]
    return nh.filter((limit != 0) & (mean > limit)).select(
        *rest,
        F.col("metric_name").alias("metric"),
        F.when(mean > limit * 1.2, "CRITICAL").otherwise("WARNING").alias("severity"),
        mean.alias("predicted_value"),
        limit.alias("threshold"),
        "lower_bound", "upper_bound", "trend",
        F.lit("within 1 hour").alias("time_to_breach"),
    )


def trend(fc: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """First and last value of a forecast, change, direction (stable below 5 percent) and volatility."""
    first, last = _ends()
    out = fc.groupBy(*keys).agg(
        first.alias("current_forecast"), last.alias("final_forecast"), F.stddev_samp("forecast").alias("volatility")
    )
    change = F.col("final_forecast") - F.col("current_forecast")
    pct = F.when(F.col("current_forecast") == 0, 0.0).otherwise(F.try_divide(change, F.col("current_forecast")) * 100)
    return out.withColumns({"change": change, "percent_change": pct}).withColumn(
        "trend",
        F.when(F.abs("percent_change") < 5, "stable").when(F.col("percent_change") > 0, "increasing").otherwise("decreasing"),
    )


def save_forecaster(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_forecaster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
