"""Searches, latest-n reports, label matchers and constraint reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.dates import before, moment
from fleetlens.functions.numeric import col
from fleetlens.plans.ordered import last_n, running
from fleetlens.schemas import SEVERITIES, STATUSES


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, keys: Sequence[tuple[str, bool]], size: int, after: Sequence | None = None) -> DataFrame:
    """The page behind a row: `keys` are (column, descending) and tell rows apart, `after` has their values in the last row
    of the page before; None for the first page.

    What lies before the row is ruled out at the scan by a bound on the first key, and of the rest each task keeps
    `size` rows, so that every page costs what the first one does."""
    order = [F.desc(c) if down else F.asc(c) for c, down in keys]
    if after is not None:
        at = [F.lit(v).cast(df.schema[c].dataType) for (c, _), v in zip(keys, after)]
        beyond = [F.col(c) < v if down else F.col(c) > v for (c, down), v in zip(keys, at)]
        later, same = beyond[-1], list(zip([c for c, _ in keys], at))
        for k in range(len(keys) - 2, -1, -1):
            later = beyond[k] | ((F.col(same[k][0]) == same[k][1]) & later)
        first, down = keys[0]
        df = df.filter((F.col(first) <= at[0]) if down else (F.col(first) >= at[0])).filter(later)
    return df.orderBy(*order).limit(size)


def page_index(df: DataFrame, keys: Sequence[tuple[str, bool]], size: int) -> DataFrame:
    """(page, keys of its first row) of every page, by ranks that are spread over all tasks. With the row before it, or with the
    row itself and a page that includes it, any page is read by key. Descending keys are numbers or times."""
    def sortable(name: str, down: bool) -> Column:
        c = F.unix_micros(F.col(name).cast("timestamp")) if df.schema[name].dataType.typeName().startswith("timestamp") else F.col(name)
        return -c if down else c

    ranks = [f"_o{i}" for i in range(len(keys))]
    placed = running(df.select(*[c for c, _ in keys]).withColumns({o: sortable(*k) for o, k in zip(ranks, keys)}), [], ranks, sums={"_n": F.lit(1)})
    return placed.filter((F.col("_n") - 1) % size == 0).select(((F.col("_n") - 1) / size).cast("long").alias("page"), *[c for c, _ in keys])


def matching_incidents(df, as_of, hours=24, status=None, severity=None, type=None) -> DataFrame:
    """Incidents of the last `hours`; status and severity in any case."""
    out = df.filter(F.col("timestamp") >= before(as_of, hours=hours))
    if status:
        out = out.filter(F.col("status") == status.upper())
    if severity:
        out = out.filter(F.col("severity") == severity.upper())
    if type:
        out = out.filter(F.col("type") == type)
    return out


def search_incidents(df, as_of, hours=24, status=None, severity=None, type=None, limit=50, offset=0) -> DataFrame:
    """A page of matching incidents, latest first. `incident_total` counts the whole match."""
    found = matching_incidents(df, as_of, hours, status, severity, type)
    return page(found, [F.desc("timestamp"), F.desc("id")], limit, offset)


def incident_total(df, as_of, hours=24, status=None, severity=None, type=None) -> DataFrame:
    return matching_incidents(df, as_of, hours, status, severity, type).agg(F.count("*").alias("total"))


def remediation_history(df, as_of, hours=24, limit=50, offset=0) -> DataFrame:
    """A page of recent actions, latest first; ties fall back on the whole row."""
    found = df.filter(F.col("timestamp") >= before(as_of, hours=hours))
    ties = [F.desc(c) for c in df.columns if c != "timestamp"]
    return page(found, [F.desc("timestamp"), *ties], limit, offset)


RECENT_COLUMNS = [
    "timestamp",
    "cpu_usage_percent",
    "memory_usage_percent",
    "error_rate",
    "response_time_p95",
    "active_connections",
]


def recent_metrics(df: DataFrame, as_of, hours: float = 24, limit: int | None = None) -> DataFrame:
    """Samples younger than `hours`, latest first, in the columns of the report."""
    cols = ["service_name", *[c for c in RECENT_COLUMNS if c in df.columns]]
    out = df.filter(F.col("timestamp") > before(as_of, hours=hours)).select(*cols)
    out = out.orderBy(F.desc("timestamp"), "service_name")
    return out if limit is None else out.limit(limit)


def models(reg: DataFrame, active_only: bool = True) -> DataFrame:
    out = reg.filter("is_active") if active_only else reg
    return out.orderBy(F.desc("trained_at"), F.desc("id"))


def model(reg: DataFrame, id: int) -> DataFrame:
    return reg.filter(F.col("id") == id)


def anomaly_scores(df, limit=100, threshold=None, filter_first=True) -> DataFrame:
    """Latest scores at or above a severity. With `filter_first=False` the newest `limit` rows are taken
    before the severity is looked at."""
    order = [F.desc("timestamp"), F.desc("id")]
    strong = F.lit(True) if threshold is None else F.col("anomaly_severity") >= threshold
    if filter_first:
        return df.filter(strong).orderBy(*order).limit(limit)
    return df.orderBy(*order).limit(limit).filter(strong)


def failure_alerts(df: DataFrame, limit: int = 50) -> DataFrame:
    risky = df.filter(F.col("risk_level").isin("high", "medium"))
    return risky.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def training_history(reg: DataFrame, name: str | None = None, n: int = 10) -> DataFrame:
    out = reg if name is None else reg.filter(F.col("model_name") == name)
    return out.orderBy(F.desc("trained_at"), F.desc("id")).limit(n)


def recent_window(df: DataFrame, minutes: float = 60, keys: Sequence[str] = ("service_name",)) -> DataFrame:
    """Rows within `minutes` of the latest row of their key. The newest time per key is one row a key."""
    newest = df.groupBy(*keys).agg(F.max("timestamp").alias("_newest"))
    age = F.make_dt_interval(mins=F.lit(int(minutes)))
    return df.join(newest, list(keys)).filter(F.col("timestamp") >= F.col("_newest") - age).drop("_newest")


def match_labels(df: DataFrame, matchers: Sequence[tuple[str, str, str]], labels: str = "labels") -> DataFrame:
    """Keep rows whose labels satisfy every (name, op, value) with op in = != =~ !~. Patterns match the
    whole label; a missing label counts as empty text."""
    for name, op, value in matchers:
        have = F.coalesce(F.col(labels)[name], F.lit(""))
        whole = have.rlike(f"^(?:{value})$") if "~" in op else have == value
        df = df.filter(~whole if op.startswith("!") else whole)
    return df


def line_filter(df: DataFrame, *needles: str, line: str = "line") -> DataFrame:
    """Lines that contain every needle, case-sensitive."""
    for n in needles:
        df = df.filter(F.col(line).contains(n))
    return df


def json_filter(df: DataFrame, path: str, op: str, value, column: str = "line") -> DataFrame:
    """Rows whose JSON field compares with a value; a row without the field or without JSON drops out."""
    raw = F.get_json_object(F.col(column), f"$.{path}")
    have = raw if isinstance(value, str) else raw.try_cast("double")
    tests = {"=": have == value, "!=": have != value, ">": have > value, ">=": have >= value, "<": have < value, "<=": have <= value}
    return df.filter(F.try_parse_json(F.col(column)).isNotNull() & tests[op])


def latest(df: DataFrame, keys: Sequence[str], n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The newest `n` rows of each key."""
    return last_n(df, keys, [F.desc("timestamp"), *[F.desc(t) for t in ties]], n)


def recent_errors(df: DataFrame, n: int = 3) -> DataFrame:
    """The newest failed actions."""
    ties = [F.desc(c) for c in df.columns if c != "timestamp"]
    return df.filter(~F.col("success")).orderBy(F.desc("timestamp"), *ties).limit(n)


def band(value: Column | str, cuts: Sequence[tuple[float, str]], otherwise: str = "success") -> Column:
    """The name of the first cut the value exceeds; cuts run from high to low."""
    out = None
    for cut, name in cuts:
        out = F.when(col(value) > cut, name) if out is None else out.when(col(value) > cut, name)
    return out.otherwise(otherwise)


# Chart bands.
CPU_BANDS = [(80.0, "danger"), (50.0, "warning")]
ERROR_BANDS = [(0.2, "danger"), (0.1, "warning")]


def not_null(*columns: str) -> dict[str, Column]:
    return {f"{c}_null": F.col(c).isNull() for c in columns}


def one_of(column: str, allowed: Sequence[str]) -> dict[str, Column]:
    """Rows whose value is outside an enumeration; null is left to `not_null`."""
    return {f"{column}_domain": F.col(column).isNotNull() & ~F.col(column).isin(*allowed)}


def within(column: str, lo: float, hi: float) -> dict[str, Column]:
    return {f"{column}_range": ~F.col(column).between(lo, hi)}


def incident_rules() -> dict[str, Column]:
    return {
        **not_null("timestamp", "type", "severity"),
        **one_of("severity", SEVERITIES),
        **one_of("status", STATUSES),
    }


def constraint_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for all row rules in one pass."""
    counts = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")


def domain_ok(contamination: float | None = None, hours: int | None = None, predict_hours: int | None = None) -> bool:
    """Whether request parameters lie in their documented ranges."""
    return (
        (contamination is None or 0.01 <= contamination <= 0.15)
        and (hours is None or 1 <= hours <= 24)
        and (predict_hours is None or 1 <= predict_hours <= 72)
    )


def resolve_config(cf: DataFrame, key: Sequence[str] = ("key",)) -> DataFrame:
    """Effective settings of each configuration document: its own value, else that of an older section,
    else the default."""
    def at(path):
        return F.get_json_object(F.col("value"), f"$.{path}").try_cast("double")

    own = F.get_json_object(F.col("value"), "$.circuit_breaker").isNotNull()
    def breaker(field, older, default):
        ours = at(f"circuit_breaker.{field}")
        theirs = F.coalesce(at(f"remediation.{older}"), F.lit(default)) if older else F.lit(default)
        return F.when(own, ours).otherwise(theirs)

    return cf.select(
        *key,
        F.coalesce(at("thresholds.cpu_percent"), F.lit(70.0)).alias("cpu_warning"),
        F.coalesce(at("thresholds.cpu_percent"), F.lit(80.0)).alias("cpu_critical"),
        F.lit(75.0).alias("memory_warning"),
        F.lit(85.0).alias("memory_critical"),
        F.coalesce(at("thresholds.error_rate"), F.lit(0.2)).alias("error_rate"),
        breaker("failure_threshold", "max_restarts_per_5min", 3.0).alias("failure_threshold"),
        breaker("recovery_timeout", "cooldown_seconds", 60.0).alias("recovery_timeout"),
        breaker("success_threshold", None, 2.0).alias("success_threshold"),
    )


def unread_count(inc: DataFrame, reads: DataFrame, n: int = 8, keys: Sequence[str] = ()) -> DataFrame:
    """Per user: how many of the latest `n` active incidents came after the user's last read.

    The newest n incident times become one short array a row, joined to each user; with `keys` each
    user sees the incidents of their own key."""
    active = inc.filter(F.col("status") == "ACTIVE")
    if keys:
        top = latest(active, keys, n, ("id",))
    else:
        top = active.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    marks = top.groupBy(*keys).agg(F.collect_list("timestamp").alias("_times"))  # at most n values
    if keys:
        seen = reads.join(marks, list(keys), "left")
    else:
        # One row, of at most n times.
        seen = reads.withColumn("_one", F.lit(1)).join(F.broadcast(marks.withColumn("_one", F.lit(1))), "_one", "left")
    unread = F.size(F.filter("_times", lambda t: t > F.col("last_read")))
    return seen.select(*reads.columns, F.when(F.col("_times").isNull(), 0).otherwise(unread).alias("unread"))


def require_rows(df: DataFrame, n: int) -> DataFrame:
    """Pass the frame on if it has at least `n` rows; reads no more than it needs to know."""
    have = df.limit(n).count()
    if have < n:
        raise ValueError(f"need at least {n} rows, got {have}")
    return df


def series_with_rows(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of the keys that have at least `n` rows."""
    enough = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select(*keys)
    return df.join(enough, list(keys), "left_semi")


def drop_older(df: DataFrame, ts: str, as_of, hours: float) -> DataFrame:
    return df.filter(F.col(ts) >= before(moment(as_of), hours=hours))


def row_numbered(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
