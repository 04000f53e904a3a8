"""Counter rates, evaluation grids, alert states and rules over metric samples.

Rates add the reset-aware increments inside the window and divide by its length; values are not
extrapolated to the window edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.dates import seconds_between
from fleetlens.operators.aggregates import histogram_quantile
from fleetlens.plans.intervals import micros, trailing_sum
from fleetlens.plans.ordered import running, settle, with_history
from fleetlens.session import durable
from fleetlens.sources.partitions import append_batch, delete_rows, exists, read_table


def increments(df, keys, by=("timestamp",), value="value", name="increment", **how) -> DataFrame:
    """Growth since the former sample; after a reset the new value itself. 0 for the first sample."""
    def build(d, w):
        prev = F.lag(value, 1).over(w)
        grown = F.when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)
        return d.withColumn(name, F.coalesce(grown, F.lit(0)))

    return with_history(df, keys, by, 1, build, **how)


def counter_rate(df, keys, seconds=300, by=("timestamp",), value="value", row_id=None, **how) -> DataFrame:
    """Per-second rate over (t - seconds, t] at each sample."""
    how = settle(df, keys, how)
    grown = increments(df, keys, by, value, "_inc", **how)
    out = trailing_sum(grown, keys, "timestamp", row_id or [*keys, *by], seconds, {"_sum": F.col("_inc")}, False, **how)
    return out.withColumn("rate", F.col("_sum") / F.lit(float(seconds))).drop("_inc", "_sum")


def counter_increase(df, keys, seconds=300, **kw) -> DataFrame:
    """Growth over the window: the rate times its length."""
    return counter_rate(df, keys, seconds, **kw).withColumn("increase", F.col("rate") * seconds).drop("rate")


def _cell(step: float) -> Column:
    """Number of the first grid point at or after the sample."""
    return F.ceil(micros("timestamp") / F.lit(int(step * 1_000_000)))


def _grid_time(cell: Column, step: float) -> Column:
    return F.timestamp_micros(cell * F.lit(int(step * 1_000_000))).cast("timestamp_ntz")


def _window_rate(cells: DataFrame, keys, seconds: float, step: float) -> DataFrame:
    """Rate at every grid point from the growth `_inc` of each (series, `_cell`)."""
    spread = cells.withColumn("_cell", F.explode(F.sequence(F.col("_cell"), F.col("_cell") + int(seconds / step) - 1)))
    rate = spread.groupBy(*keys, "_cell").agg((F.sum("_inc") / F.lit(float(seconds))).alias("value"))
    return rate.select(*keys, _grid_time(F.col("_cell"), step).alias("timestamp"), "value")


def grid_rate(df, keys, seconds=300, step=30, by=("timestamp",), value="value", **how) -> DataFrame:
    """Rate over (t - seconds, t] at every grid point t whose window holds a sample.

    Increments shrink to one row per (series, step) before they are spread over the windows they touch."""
    if seconds % step:
        raise ValueError("the window must be a whole number of steps")
    grown = increments(df, keys, by, value, "_inc", **how)
    return _window_rate(grown.groupBy(*keys, _cell(step).alias("_cell")).agg(F.sum("_inc").alias("_inc")), keys, seconds, step)


def _latest(cells: DataFrame, keys, step: float, staleness: float = 300) -> DataFrame:
    """Latest value at every grid point from the last one of each (series, `_cell`) and its time `_at`."""
    spread = cells.withColumn("_g", F.explode(F.sequence(F.col("_cell"), F.col("_cell") + int(staleness / step))))
    spread = spread.withColumn("_t", _grid_time(F.col("_g"), step))
    fresh = spread.filter(seconds_between("_at", "_t") <= staleness)
    return fresh.groupBy(*keys, F.col("_t").alias("timestamp")).agg(F.max_by("value", "_at").alias("value"))


def instant(df, keys, step=30, staleness=300, by=("timestamp",), value="value") -> DataFrame:
    """Latest sample at or before every grid point, no older than `staleness` seconds."""
    cells = df.groupBy(*keys, _cell(step).alias("_cell")).agg(F.max_by(value, F.struct(*by)).alias("value"), F.max("timestamp").alias("_at"))
    return _latest(cells, keys, step, staleness)


def recording_rule(df: DataFrame, record: str, expr: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """The named result of an expression on its grid; written to `path` when one is given."""
    out = expr(df).withColumn("record", F.lit(record))
    if path is not None:
        out.write.mode("append").parquet(path)
    return out


def update_rule(spark, path: str, df: DataFrame, record: str, expr: Callable[[DataFrame], DataFrame], keys: Sequence[str], window_s: float, by: Sequence[str] = ("timestamp",)) -> int:
    """Bring the stored points of a recording rule up to date with the samples `df`, which may have grown at their end; the number
    of points written.

    A point is closed once a sample behind it is there. Closed points are kept as they are; the open ones go, and
    they and those after them are evaluated from the samples that their windows touch and, for the growth of counters, the
    one before these in each series. Repeated over the same samples it writes the same points again."""
    newest = df.agg(F.max("timestamp").alias("t")).first()["t"]
    if newest is None:
        return 0
    last = None
    if exists(spark, path):
        last = read_table(spark, path).filter((F.col("record") == record) & ~F.col("open")).agg(F.max("timestamp").alias("t")).first()["t"]
    rows = df
    if last is not None:
        start = F.lit(last) - F.make_dt_interval(secs=F.lit(float(window_s)))
        former = df.filter(F.col("timestamp") <= start).groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*by)).alias("_r")).select("_r.*")
        rows = df.filter(F.col("timestamp") > start).unionByName(former)
    points = expr(rows).withColumns({"record": F.lit(record), "open": F.col("timestamp") > F.lit(newest), "date": F.to_date("timestamp")})
    points = durable(points if last is None else points.filter(F.col("timestamp") > F.lit(last)))
    if exists(spark, path):
        gone = (F.col("record") == record) & F.col("open") if last is None else (F.col("record") == record) & (F.col("timestamp") > F.lit(last))
        delete_rows(spark, path, ["date"], gone, F.lit(True) if last is None else F.col("date") >= F.to_date(F.lit(last)))
    append_batch(points, path, ["date"], f"{record}-{last}-{newest}".replace(":", ".").replace(" ", "T"))
    return points.count()


def alert_states(df, keys, cond: Column, for_s: float | Column, by=("timestamp",), **how) -> DataFrame:
    """inactive, pending or firing at each evaluation: firing once the condition has held for `for_s`
    seconds without a break."""
    def build(d, w):
        before = F.coalesce(F.lag("_on", 1).over(w), F.lit(False))
        return d.withColumn("_begin", F.when(F.col("_on") & ~before, F.col("timestamp")))

    how = settle(df, keys, how)
    on = df.withColumn("_on", F.coalesce(cond, F.lit(False)))
    begun = with_history(on, keys, by, 1, build, **how)
    out = running(begun, keys, by, last={"active_since": F.col("_begin")}, **how)
    held = seconds_between("active_since", "timestamp") >= for_s
    state = F.when(~F.col("_on"), "inactive").when(held, "firing").otherwise("pending")
    return (
        out.withColumn("state", state)
        .withColumn("active_since", F.when(F.col("_on"), F.col("active_since")))
        .drop("_on", "_begin")
    )


def action_counts(df, keys=("service_name", "action_type"), seconds=300, row_id=("id",), **how) -> DataFrame:
    """Actions of the same kind in the last `seconds`, both ends included."""
    return trailing_sum(df, keys, "timestamp", row_id, seconds, {"recent_actions": F.lit(1)}, **how)


def log_rate(df: DataFrame, size: str, seconds: float, keys: Sequence[str] = (), step: str | None = None) -> DataFrame:
    """Lines per second in each time window."""
    w = F.window("timestamp", size, step or size)
    return df.groupBy(*keys, w.alias("_w")).agg((F.count("*") / F.lit(float(seconds))).alias("rate")).select(
        *keys, F.col("_w.start").alias("window_start"), "rate"
    )


# Alert rules as (name, metric, label matchers, function, window s, comparison, bound, for s,
# severity, component, summary). A `rate` applies to counters, `p95` to histogram buckets.
RULES = [
    ("HighErrorRate", "http_requests_total", [("status", "=~", "5..")], "rate", 300, ">", 0.05, 120, "critical", "app", "High error rate detected"),
    ("HighCPUUsage", "process_cpu_seconds_total", [], "rate", 300, ">", 0.8, 300, "warning", "app", "High CPU usage detected"),
    ("HighMemoryUsage", "process_resident_memory_bytes", [], "value", 0, ">", 5e8, 300, "warning", "app", "High memory usage detected"),
    ("ApplicationDown", "up", [("job", "=", "flask-app")], "value", 0, "==", 0.0, 60, "critical", "app", "Application is down"),
    ("HighResponseTime", "http_request_duration_seconds_bucket", [], "p95", 300, ">", 0.5, 180, "warning", "app", "High response time detected"),
    ("FrequentRemediations", "remediation_actions_total", [], "rate", 600, ">", 0.5, 300, "warning", "bot", "Frequent remediation actions"),
    ("RemediationFailures", "remediation_failures_total", [], "rate", 300, ">", 0.1, 120, "critical", "bot", "Remediation actions failing"),
    ("CircuitBreakerOpen", "circuit_breaker_state", [], "value", 0, ">", 0.0, 60, "warning", "bot", "Circuit breaker is open"),
    ("DatabaseConnectionIssues", "database_errors_total", [], "rate", 300, ">", 0.1, 120, "critical", "database", "Database connection issues"),
    ("HighIncidentCount", "incidents_total", [], "value", 0, ">", 100.0, 300, "info", "monitoring", "High number of incidents"),
    ("ErrorPercent", "error_percent", [], "value", 0, ">", 5.0, 0, "warning", "app", "Error rate above 5 percent"),
    ("SlowResponses", "response_time_p95_ms", [], "value", 0, ">", 500.0, 0, "warning", "app", "P95 above 500 ms"),
    ("CPUExhaustion", "cpu_usage_percent", [], "value", 0, ">", 90.0, 0, "critical", "app", "CPU above 90 percent"),
    ("MemoryExhaustion", "memory_usage_percent", [], "value", 0, ">", 85.0, 0, "warning", "app", "Memory above 85 percent"),
    ("IncidentBurst", "incidents_total", [], "increase", 300, ">", 10.0, 0, "warning", "bot", "More than 10 incidents in 5 minutes"),
]


# Separators of a label set written as one text; neither may occur in a label.
_PAIR, _IS = "\u0001", "\u0002"


def _series(labels: Column) -> Column:
    """A label set as one sortable text, which keys the series."""
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(_IS), e["value"])), _PAIR)


def _matches(labels: Column, matchers) -> Column:
    ok = F.lit(True)
    for name, op, value in matchers:
        have = F.coalesce(labels[name], F.lit(""))
        whole = have.rlike(f"^(?:{value})$") if "~" in op else have == value
        ok = ok & (~whole if op.startswith("!") else whole)
    return ok


def _panes(samples: DataFrame, metrics: Sequence[str], step: float, **how) -> DataFrame:
    """(metric, series, _cell, _inc, value, _at): what each series did in each step that holds a sample: its growth, its last
    value and when. All that rules ask of samples, whatever their windows; made durable, so samples are read once."""
    keys = ["metric", "series"]
    rows = samples.filter(F.col("metric").isin(*metrics)).select("metric", _series(F.col("labels")).alias("series"), "timestamp", "value")
    grown = increments(rows, keys, ("timestamp",), "value", "_inc", **how)
    return durable(
        grown.groupBy(*keys, _cell(step).alias("_cell")).agg(
            F.sum("_inc").alias("_inc"), F.max_by("value", "timestamp").alias("value"), F.max("timestamp").alias("_at")
        )
    )


def _labels() -> Column:
    return F.str_to_map("series", F.lit(_PAIR), F.lit(_IS))


def _rule_values(panes: DataFrame, fn: str, window: float, metrics: list[str], step: float) -> DataFrame:
    """(metric, series, timestamp, value) of one function over all metrics that a rule applies it to."""
    rows = panes.filter(F.col("metric").isin(metrics))
    keys = ["metric", "series"]
    if fn == "value":
        return _latest(rows, keys, step)
    if fn in ("rate", "increase"):
        rate = _window_rate(rows, keys, window, step)
        return rate if fn == "rate" else rate.withColumn("value", F.col("value") * window)
    if fn == "p95":
        le = F.regexp_replace(_labels()["le"], r"^\+Inf$", "Infinity").try_cast("double")
        parts = rows.withColumn("le", le).filter(F.col("le").isNotNull()).withColumn("series", _series(F.map_filter(_labels(), lambda k, v: k != "le")))
        q = histogram_quantile(_window_rate(parts, [*keys, "le"], window, step), 0.95, [*keys, "timestamp"], cum="value")
        return q.withColumnRenamed("quantile", "value")
    raise ValueError(f"unknown rule function {fn!r}")


def evaluate_rules(samples: DataFrame, rules=None, step: float = 30, **how) -> DataFrame:
    """State of every rule for every series at every grid point with data.

    Input (timestamp, metric, labels, value); output (alert, series, timestamp, value, state, severity,
    component, summary). The samples are read once and shrink to one row per series and step; each (function,
    window) is evaluated once for all its rules from these, and all rules share one pass for their states."""
    rules = RULES if rules is None else rules
    panes = _panes(samples, sorted({r[1] for r in rules}), step, **how)
    classes: dict[tuple, list] = {}
    for r in rules:
        classes.setdefault((r[3], r[4]), []).append(r)
    parts = []
    for (fn, window), members in classes.items():
        values = _rule_values(panes, fn, window, sorted({r[1] for r in members}), step)
        labels, v = _labels(), F.col("value")
        hits = []
        for name, metric, match, _, _, op, bound, hold, severity, component, summary in members:
            on = {">": v > bound, "==": v == bound, "<": v < bound}[op]
            rule = F.struct(
                F.lit(name).alias("alert"), on.alias("on"), F.lit(float(hold)).alias("hold"), F.lit(severity).alias("severity"),
                F.lit(component).alias("component"), F.lit(summary).alias("summary"),
            )
            hits.append(F.when((F.col("metric") == metric) & _matches(labels, match), rule))
        each = F.filter(F.array(*hits), lambda r: r.isNotNull())
        parts.append(values.select("series", "timestamp", v.cast("double").alias("value"), F.inline(each)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # A series has at most one row per grid point, so its rows are bounded by the time range.
    states = alert_states(out, ["alert", "series"], F.col("on"), F.col("hold"), **{"limit": None, **how})
    shown = F.translate("series", _PAIR + _IS, ",=")
    return states.withColumn("series", shown).select(
        "alert", "series", "timestamp", "value", "state", "severity", "component", "summary"
    )
