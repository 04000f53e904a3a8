"""Incident deduplication and the circuit breaker, on tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.dates import moment, seconds_between
from fleetlens.plans.replay import JumpTable, replay
from fleetlens.schemas import BREAKER

SECOND = 1_000_000


@dataclass(frozen=True)
class FirstPerWindow:
    """Let a row through when the last one let through is at least `window_s` old. The state is the time
    from which rows pass again."""

    window_s: float

    inputs = ()
    outputs = ("emitted",)
    schema = "emitted boolean"

    def fresh(self):
        return None

    def settle(self, state, us):
        return None if state is None or state <= us else state

    def exits(self):
        return JumpTable(max(int(self.window_s * SECOND), 1))

    def run(self, state, us, cols):
        w = max(int(self.window_s * SECOND), 1)
        ok = np.zeros(len(us), dtype=bool)
        i = 0 if state is None else int(np.searchsorted(us, state))
        after = np.searchsorted(us, us + w)
        while i < len(us):
            ok[i] = True
            state = int(us[i]) + w
            i = int(after[i])
        return state, {"emitted": ok}


@dataclass(frozen=True)
class Breaker:
    """Replay of action requests of one service. An allowed request runs at once with its `success`.

    Only actions that ran count towards the limit of their kind; an open breaker stops every kind."""

    max_actions: int
    window_s: float
    cooldown_s: float

    inputs = ("_kind", "_ok")
    outputs = ("allowed", "denied_by", "breaker_state", "failure_count", "recent", "opened_us")
    schema = "allowed boolean, denied_by string, breaker_state string, failure_count int, recent int, opened_us long"

    def fresh(self):
        return {"state": "CLOSED", "opened": None, "failures": 0, "ran": {}}

    def settle(self, state, us):
        oldest = us - int(self.window_s * SECOND)
        ran = {k: kept for k, v in state["ran"].items() if (kept := [x for x in v if x >= oldest])}
        now = {**state, "ran": ran}
        if state["state"] == "OPEN" and us - state["opened"] >= self.cooldown_s * SECOND:
            now["state"] = "HALF_OPEN"
        return None if now == self.fresh() else now

    def run(self, state, us, cols):
        n = len(us)
        kinds, oks = cols["_kind"], cols["_ok"]
        window, cooldown = int(self.window_s * SECOND), int(self.cooldown_s * SECOND)
        s, opened, failures = state["state"], state["opened"], state["failures"]
        ran = {k: list(v) for k, v in state["ran"].items()}
        allowed, why = np.zeros(n, dtype=bool), np.full(n, None, dtype=object)
        states, fails = np.full(n, s, dtype=object), np.zeros(n, dtype=np.int32)
        recent, open_us = np.zeros(n, dtype=np.int32), np.full(n, None, dtype=object)
        i = 0
        while i < n:
            t = int(us[i])
            if s == "OPEN" and t - opened < cooldown:
                # Everything up to the end of the cooldown is denied alike.
                j = int(np.searchsorted(us, opened + cooldown))
                why[i:j], states[i:j], fails[i:j], open_us[i:j] = "cooldown", s, failures, opened
                i = j
                continue
            if s == "OPEN":
                s = "HALF_OPEN"
            times = [x for x in ran.get(kinds[i], ()) if x >= t - window]
            recent[i] = len(times)
            if len(times) >= self.max_actions:
                s, opened, failures = "OPEN", t, len(times)
                why[i] = "limit"
            else:
                allowed[i] = True
                times.append(t)
                if oks[i] and s == "HALF_OPEN":
                    s, opened, failures = "CLOSED", None, 0
                elif not oks[i]:
                    failures += 1
            ran[kinds[i]] = times
            states[i], fails[i], open_us[i] = s, failures, opened
            i += 1
        left = {"state": s, "opened": opened, "failures": failures, "ran": ran}
        return left, dict(zip(self.outputs, (allowed, why, states, fails, recent, open_us)))


@dataclass(frozen=True)
class Increments:
    """Growth of a counter since its former sample; the value itself after a reset. The state is the last value."""

    inputs = ("_value",)
    outputs = ("increment",)
    schema = "increment double"

    def fresh(self):
        return None

    def settle(self, state, us):
        return state

    def run(self, state, us, cols):
        v = cols["_value"].astype(float)
        before = np.concatenate(([np.nan if state is None else state], v[:-1]))
        grown = np.where(v < before, v, v - before)
        grown[np.isnan(before)] = 0.0
        return (float(v[-1]) if len(v) else state), {"increment": grown}


def dedupe(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", window_s: float = 60, ties=("id",), **how) -> DataFrame:
    """Rows whose key last emitted a row at least `window_s` ago; suppressed rows do not move the clock."""
    return replay(df, keys, ts, ties, FirstPerWindow(window_s), **how).filter("emitted").drop("emitted")


def dedupe_predictions(pr: DataFrame, window_s: float = 600, **how) -> DataFrame:
    """High and medium predictions, at most one per risk level in ten minutes."""
    return dedupe(pr.filter(F.col("risk_level").isin("high", "medium")), ["risk_level"], "timestamp", window_s, **how)


def breaker_replay(
    df: DataFrame, max_actions=BREAKER["max_actions"], window_s=BREAKER["window_s"], cooldown_s=BREAKER["cooldown_s"],
    service="service_name", action="action_type", success="success", ts="timestamp", ties=("id",), **how,
) -> DataFrame:
    """Decide every action request: `allowed`, why not, and the breaker after it."""
    ready = df.withColumns({"_kind": F.col(action), "_ok": F.coalesce(F.col(success), F.lit(False))})
    out = replay(ready, [service], ts, ties, Breaker(max_actions, window_s, cooldown_s), **how)
    return out.withColumn("opened_at", F.timestamp_micros("opened_us").cast("timestamp_ntz")).drop("_kind", "_ok", "opened_us")


def breaker_states(replayed: DataFrame, as_of, cooldown_s=BREAKER["cooldown_s"], service="service_name", ts="timestamp", ties=("id",)) -> DataFrame:
    """State of each service's breaker at `as_of` with the seconds of cooldown left."""
    seen = replayed.filter(F.col(ts) <= moment(as_of))
    last = F.max_by(F.struct("breaker_state", "failure_count", "opened_at"), F.struct(ts, *ties))
    tried = F.max(F.when(F.col("allowed"), F.col(ts)))
    left = F.greatest(F.lit(0), (F.lit(float(cooldown_s)) - seconds_between("opened_at", moment(as_of))).cast("int"))
    out = seen.groupBy(service).agg(last.alias("_l"), tried.alias("last_attempt")).select(service, "last_attempt", "_l.*")
    return out.withColumn("cooldown_remaining_seconds", F.when(F.col("opened_at").isNotNull(), left))


def reset_breakers(states: DataFrame, services: Sequence[str], service="service_name") -> DataFrame:
    """The named services back to a closed breaker without history."""
    hit = F.col(service).isin(list(services))
    closed = {"breaker_state": F.lit("CLOSED"), "failure_count": F.lit(0), "opened_at": F.lit(None), "last_attempt": F.lit(None), "cooldown_remaining_seconds": F.lit(None)}
    return states.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in closed.items()})


# Reasons of denials and escalations.
COOLING = "Circuit OPEN for %s. Cooldown: %ds remaining"
LIMITED = "Circuit OPEN for %s: %d %s actions in last %ds (max: %d)"
BLOCKED = "Circuit breaker open, auto-remediation blocked: "
FAILED = "Remediation action failed: "


def denial_reason(service="service_name", action="action_type", ts="timestamp", window_s=BREAKER["window_s"], max_actions=BREAKER["max_actions"], cooldown_s=BREAKER["cooldown_s"]):
    """Text of why a replayed request was denied."""
    left = (F.lit(float(cooldown_s)) - seconds_between("opened_at", ts)).cast("int")
    return F.when(
        F.col("denied_by") == "cooldown",
        F.format_string(COOLING, F.col(service), left),
    ).when(
        F.col("denied_by") == "limit",
        F.format_string(LIMITED, F.col(service), F.col("recent"), F.col(action), F.lit(int(window_s)), F.lit(int(max_actions))),
    )


def escalations(replayed: DataFrame, error: str | None = None, service="service_name", success="success", **names) -> DataFrame:
    """Requests a person must look at: blocked by the breaker, or run and failed."""
    failed = F.col("allowed") & ~F.coalesce(F.col(success), F.lit(False))
    blocked = ~F.col("allowed")
    text = F.coalesce(F.col(error), F.lit("unknown")) if error else F.lit("unknown")
    reason = F.when(
        blocked, F.concat(F.lit(BLOCKED), denial_reason(service=service, **names))
    ).otherwise(F.concat(F.lit(FAILED), text))
    return replayed.filter(blocked | failed).withColumn("kind", F.when(blocked, "blocked").otherwise("failed")).withColumn("reason", reason)


def mark_escalated(inc: DataFrame, esc: DataFrame, incident_id: str = "incident_id") -> DataFrame:
    """Incidents with an escalation get the status ESCALATED unless they are resolved."""
    ids = esc.select(F.col(incident_id).alias("id")).distinct().withColumn("_e", F.lit(True))
    hit = F.coalesce("_e", F.lit(False)) & (F.col("status") != "RESOLVED")
    return inc.join(ids, "id", "left").withColumn("status", F.when(hit, "ESCALATED").otherwise(F.col("status"))).drop("_e")
