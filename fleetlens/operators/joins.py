"""Joins of incidents, actions, scores, predictions, forecasts and settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.dates import before
from fleetlens.plans.intervals import exists_between, interval_join, sum_between
from fleetlens.schemas import KEYS
from fleetlens.session import MAX_ROWS_PER_TASK

# Incidents and actions that one task joins and sorts, and the groups of ids in which they are counted first.
DETAIL_ROWS, DETAIL_GROUPS = 1_000_000, 4096
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000


def _span(seconds: float):
    return F.make_dt_interval(secs=F.lit(float(seconds)))


def recent_incidents(inc: DataFrame, act: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """Incidents younger than `hours` with their number of actions, 0 without any.

    Only actions of these incidents are counted, before the join, so an incident with very many brings one row."""
    fresh = inc.filter(F.col("timestamp") > before(as_of, hours=hours))
    mine = act.join(fresh.select(F.col("id").alias("incident_id")), "incident_id", "left_semi")
    tries = mine.groupBy(F.col("incident_id").alias("id")).agg(F.count("*").alias("remediation_attempts"))
    return fresh.join(tries, "id", "left").withColumn(
        "remediation_attempts", F.coalesce("remediation_attempts", F.lit(0).cast("long"))
    )


def incident_detail(inc: DataFrame, act: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Incidents beside their actions in time order, one row per action (one row without any).

    Rows, not a nested list: an incident may have more actions than one row can hold. One count over the ids sets the number
    of tasks, so that a task has about `DETAIL_ROWS` rows whatever the size of the tables."""
    if ids is not None:
        inc = inc.filter(F.col("id").isin(list(ids)))
        act = act.filter(F.col("incident_id").isin(list(ids)))
    a = act.select(
        F.col("incident_id").alias("id"),
        F.col("timestamp").alias("action_timestamp"),
        "action_type",
        "target",
        "success",
        "execution_time_ms",
    )
    group = F.pmod(F.xxhash64("id"), F.lit(DETAIL_GROUPS))
    sizes = inc.select("id").unionAll(a.select("id")).groupBy(group.alias("g")).agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    n = max(int(inc.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // DETAIL_ROWS))
    dealt = inc.repartition(n, "id")
    if most <= max(MAX_ROWS_PER_TASK, 4 * total // DETAIL_GROUPS):
        both = dealt.join(a.repartition(n, "id"), "id", "left")
    else:
        # An inner join, whose hot ids Spark can split on the side of the actions, and the incidents without any.
        lonely = dealt.join(a.select("id").repartition(n, "id").distinct(), "id", "left_anti")
        both = inc.join(a, "id").unionByName(lonely, allowMissingColumns=True)
    order = ["id", "action_timestamp", "action_type", "target"]
    return both.repartitionByRange(n, *order).sortWithinPartitions(*order)


def match_anomalies(sc: DataFrame, inc: DataFrame, keys: Sequence[str] = (), minutes: float = 10, name="matched") -> DataFrame:
    """Flag each anomalous score with an `ml_anomaly` incident within `minutes` on either side."""
    found = inc.filter(F.col("type") == "ml_anomaly")
    flagged = sc.filter("is_anomaly")
    t, d = F.col("timestamp"), _span(minutes * 60)
    return exists_between(flagged, found, keys, t - d, t + d, "timestamp", int(2 * minutes * MINUTE_US), name)


def match_predictions(pr: DataFrame, inc: DataFrame, keys: Sequence[str] = (), hours: float = 1, name="matched") -> DataFrame:
    """Flag each high or medium prediction that an incident follows within `hours`."""
    risky = pr.filter(F.col("risk_level").isin("high", "medium"))
    t = F.col("timestamp")
    return exists_between(risky, inc, keys, t, t + _span(hours * 3600), "timestamp", int(hours * HOUR_US), name)


def count_matches(
    left: DataFrame, inc: DataFrame, keys: Sequence[str], row_id: Sequence[str], back_s: float, ahead_s: float,
    name: str = "matches", **how,
) -> DataFrame:
    """How many incidents lie in [t - back_s, t + ahead_s] of each left row, without listing them."""
    t = F.col("timestamp")
    out = sum_between(
        left, inc, keys, row_id, t - _span(back_s), t + _span(ahead_s), "timestamp", {name: F.lit(1)}, **how
    )
    return out.withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def match_forecasts(fc: DataFrame, actual: DataFrame, minutes: float = 5) -> DataFrame:
    """Forecasts beside the measured values of the same series within `minutes`."""
    t, d = F.col("predicted_timestamp"), _span(minutes * 60)
    return interval_join(
        fc, actual, ["service", "metric_name"], t - d, t + d, "timestamp", int(2 * minutes * MINUTE_US)
    )


def label_next_hour(feat: DataFrame, inc: DataFrame, hours: float = 1, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """`label` 1 where an incident of the key occurs in [t, t + hours], else 0."""
    t = F.col("timestamp")
    hit = exists_between(feat, inc, keys, t, t + _span(hours * 3600), "timestamp", int(hours * HOUR_US), "_hit")
    return hit.select(*feat.columns, F.col("_hit").cast("int").alias("label"))


def report_bundle(inc: DataFrame, ana: DataFrame, act: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Each incident with its latest analysis and its actions in time order, one row per action."""
    newest = ana.groupBy(F.col("incident_id").alias("id")).agg(
        F.max_by("root_cause", F.struct("analyzed_at", "root_cause")).alias("root_cause"),
        F.max("analyzed_at").alias("analyzed_at"),
    )
    return incident_detail(inc.join(newest, "id", "left"), act, ids)


def with_thresholds(df: DataFrame, th: DataFrame, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Add the threshold columns of each key. The side is left to Spark, which measures it at run time."""
    return df.join(th, list(keys), "left")


def orphans(act: DataFrame, inc: DataFrame) -> DataFrame:
    """Actions whose incident does not exist."""
    return act.join(inc.select(F.col("id").alias("incident_id")), "incident_id", "left_anti").select(*act.columns)


def cascade_delete(act: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions that stay, actions that go with the deleted incidents)."""
    gone = deleted.select(F.col("id").alias("incident_id"))
    return (
        act.join(gone, "incident_id", "left_anti").select(*act.columns),
        act.join(gone, "incident_id", "left_semi").select(*act.columns),
    )


# Priority of overlapping phases and their lengths in seconds.
PHASES = {"active": 4, "remediation": 3, "recovery": 2, "buildup": 1}
BUILDUP_S, REMEDIATION_S = 3600, 120
# The leak scenario is active above this much memory, in percent, and builds up below it.
LEAK_ACTIVE_MEMORY = 80
RECOVERY_S = {"cpu_spike": 1800, "memory_leak": 1800, "error_storm": 900}


def tag_phases(
    metrics: DataFrame, inc: DataFrame, scenario: str = "cpu_spike", active_s: int = 600, keys: Sequence[str] = tuple(KEYS)
) -> DataFrame:
    """Label samples by their phase around incidents: buildup, active, remediation, recovery or normal.

    Each phase is one existence test on the incident starts, so overlapping incidents cost nothing and
    the strongest phase wins."""
    t = F.col("timestamp")
    rec = RECOVERY_S[scenario]
    # A sample at t is in the phase [start + a, start + b) iff a start lies in (t - b, t - a].
    spans = {
        "buildup": (-BUILDUP_S, 0),
        "active": (0, active_s),
        "remediation": (active_s, active_s + REMEDIATION_S),
        "recovery": (active_s + REMEDIATION_S, active_s + REMEDIATION_S + rec),
    }
    us = 0.000001
    out = metrics
    for phase, (a, b) in spans.items():
        width = int((b - a) * 1_000_000) - 1
        lo, hi = t - _span(b) + F.make_dt_interval(secs=F.lit(us)), t - _span(a)
        out = exists_between(out, inc, keys, lo, hi, "timestamp", width, f"_in_{phase}")
    tag = F.lit("normal")
    for phase in sorted(PHASES, key=PHASES.get):
        name = F.lit(f"{scenario}_{phase}")
        if scenario == "memory_leak" and phase == "active":
            name = F.when(F.col("memory_usage_percent") > LEAK_ACTIVE_MEMORY, name).otherwise(f"{scenario}_buildup")
        tag = F.when(F.col(f"_in_{phase}"), name).otherwise(tag)
    return out.select(*metrics.columns, tag.alias("label"))
