"""The ways for hot keys must give what the plain ways give."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import features as ft
from fleetlens.operators import joins as jn
from fleetlens.operators import promlike as prom
from fleetlens.operators import stateful
from fleetlens.operators import windows as win
from fleetlens.plans import replay as rp
from fleetlens.plans.ordered import running
from fleetlens.plans.quantiles import grouped_quantiles
from fleetlens.sources import tables as t

HOT = {"limit": 0, "blocks": 7}
T0 = datetime(2024, 1, 1)


def rows(df):
    cols = sorted(df.columns)
    out = [tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect()]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def wide(spark, small):
    return t.metrics_wide(spark, small).cache()


@pytest.fixture(scope="module")
def skewed(spark):
    """One key has most rows; others have one to a few, so that blocks begin inside and between keys."""
    r = random.Random(5)
    data, i = [], 0
    for key, n in [("a", 400), ("b", 1), ("c", 2), ("d", 35), ("e", 3), ("f", 150)]:
        at = T0
        for _ in range(n):
            at += timedelta(seconds=r.choice([1, 5, 20, 59, 60, 61, 300]))
            v = None if r.random() < 0.4 else float(r.randint(0, 20))
            data.append((i, key, at, v, r.random() < 0.6, r.choice(["restart", "scale"])))
            i += 1
    return spark.createDataFrame(data, "id long, service_name string, timestamp timestamp_ntz, value double, success boolean, action_type string").cache()


def test_rolling_and_lags(wide):
    assert rows(win.rolling_z(wide, ["error_rate"], **HOT)) == rows(win.rolling_z(wide, ["error_rate"]))
    assert rows(win.lags(wide, ["error_rate"], **HOT)) == rows(win.lags(wide, ["error_rate"]))


@pytest.mark.parametrize("blocks", [2, 9, 40])
def test_history_over_small_blocks(skewed, blocks):
    by = ["timestamp", "id"]
    hot = win.lags(skewed, ["value"], (1, 30), by=by, limit=0, blocks=blocks)
    assert rows(hot) == rows(win.lags(skewed, ["value"], (1, 30), by=by))
    hot = win.rate_of_change(skewed, ["value"], by=by, limit=0, blocks=blocks)
    assert rows(hot) == rows(win.rate_of_change(skewed, ["value"], by=by))


def test_features(wide):
    assert rows(ft.extract_features(wide, **HOT)) == rows(ft.extract_features(wide))


@pytest.mark.parametrize("blocks", [3, 25])
def test_running(skewed, blocks):
    by = ["timestamp", "id"]
    spec = dict(sums={"s": F.col("value"), "n": F.lit(1)}, last={"l": F.col("value")}, totals={"t": F.col("value")})
    assert rows(running(skewed, ["service_name"], by, **spec, limit=0, blocks=blocks)) == rows(running(skewed, ["service_name"], by, **spec))


def test_quantiles(skewed):
    probs = {"a": 0.0, "p5": 0.5, "p95": 0.95, "z": 1.0}
    for method in ("linear", "index"):
        hot = grouped_quantiles(skewed, ["service_name"], "value", probs, method, 0, 6)
        assert rows(hot) == rows(grouped_quantiles(skewed, ["service_name"], "value", probs, method))


def test_global_rank(skewed):
    got = running(skewed, [], ["timestamp", "id"], sums={"n": F.lit(1)}, blocks=6).orderBy("timestamp", "id").collect()
    assert [r["n"] for r in got] == list(range(1, len(got) + 1))
    train, test = ft.split(skewed, blocks=5)
    assert train.count() == int(len(got) * 0.8) and train.agg(F.max("timestamp")).first()[0] <= test.agg(F.min("timestamp")).first()[0]


def test_trailing_sums_and_rates(skewed):
    keys = ("service_name", "action_type")
    assert rows(prom.action_counts(skewed, keys, **HOT)) == rows(prom.action_counts(skewed, keys))
    c = skewed.withColumn("value", (F.col("id") % 17).cast("double"))
    a = prom.counter_rate(c, ["service_name"], 300, by=("timestamp", "id"), row_id=["id"], **HOT)
    assert rows(a) == rows(prom.counter_rate(c, ["service_name"], 300, by=("timestamp", "id"), row_id=["id"]))


def test_alert_states(skewed):
    cond = F.col("value") > 4
    a = prom.alert_states(skewed, ["service_name"], cond, 120, by=("timestamp", "id"), **HOT)
    assert rows(a) == rows(prom.alert_states(skewed, ["service_name"], cond, 120, by=("timestamp", "id")))


def test_count_matches(skewed):
    left = skewed.select("id", "service_name", "timestamp")
    inc = skewed.filter("success").select("service_name", "timestamp")
    got = {r["id"]: r["matches"] for r in jn.count_matches(left, inc, ["service_name"], ["id"], 60, 300, **HOT).collect()}
    l, i = left.collect(), inc.collect()
    for r in l:
        lo, hi = r["timestamp"] - timedelta(seconds=60), r["timestamp"] + timedelta(seconds=300)
        assert got[r["id"]] == sum(x["service_name"] == r["service_name"] and lo <= x["timestamp"] <= hi for x in i)


def greedy(data, key, window):
    last, out = {}, []
    for r in sorted(data, key=lambda r: (r["timestamp"], r["id"])):
        k = key(r)
        if k not in last or (r["timestamp"] - last[k]).total_seconds() >= window:
            last[k] = r["timestamp"]
            out.append(r["id"])
    return sorted(out)


@pytest.mark.parametrize("window", [60, 600])
@pytest.mark.parametrize("how", [{}, {"limit": 0, "blocks": 4}, {"limit": 0, "blocks": 30}])
def test_dedupe(skewed, window, how):
    got = sorted(r["id"] for r in stateful.dedupe(skewed, ["service_name"], window_s=window, **how).collect())
    assert got == greedy(skewed.collect(), lambda r: r["service_name"], window)


def test_dedupe_edges(spark):
    data = [(i, "x", T0 + timedelta(seconds=s)) for i, s in enumerate([0, 59, 60, 119, 120])]
    df = spark.createDataFrame(data, "id int, type string, timestamp timestamp_ntz")
    assert sorted(r["id"] for r in stateful.dedupe(df, ["type"]).collect()) == [0, 2, 4]


@pytest.fixture
def passes(monkeypatch):
    """How often each kind of pass over the rows was planned."""
    seen = {}
    for name in ("_tables", "_compose", "_scan", "_chain", "_emit"):
        def counted(*a, real=getattr(rp, name), name=name):
            seen[name] = seen.get(name, 0) + 1
            return real(*a)

        monkeypatch.setattr(rp, name, counted)
    return seen


def dense(spark, per_window, window=60, windows=24):
    r = random.Random(per_window)
    at = sorted(r.random() * window * windows for _ in range(per_window * windows))
    data = [(i, "hot", T0 + timedelta(microseconds=int(x * 1e6)), r.random() < 0.6, r.choice(["restart", "scale"])) for i, x in enumerate(at)]
    return spark.createDataFrame(data, "id long, service_name string, timestamp timestamp_ntz, success boolean, action_type string").cache()


@pytest.mark.parametrize("per_window", [500, 2000])
def test_passes_over_a_dense_key(spark, passes, per_window):
    """Sixteen blocks of one key: the number of passes does not follow the number of blocks."""
    df = dense(spark, per_window)
    hot = {"limit": 0, "blocks": 16}
    got = sorted(r["id"] for r in stateful.dedupe(df, ["service_name"], window_s=60, **hot).collect())
    assert got == greedy(df.collect(), lambda r: r["service_name"], 60)
    assert passes == {"_tables": 1, "_compose": 1, "_emit": 1}  # besides writing the blocks
    passes.clear()
    got = {r["id"]: (r["allowed"], r["denied_by"], r["breaker_state"], r["failure_count"]) for r in stateful.breaker_replay(df, 3, 300, 120, **hot).collect()}
    assert got == {r["id"]: (r["allowed"], r["denied_by"], r["breaker_state"], r["failure_count"]) for r in stateful.breaker_replay(df, 3, 300, 120).collect()}
    assert passes["_scan"] <= 2 and passes.get("_chain", 0) <= 1


def test_block_functions(monkeypatch):
    """A block entered with any state is left with what running it from there leaves, however batches fall."""
    r = random.Random(9)
    for _ in range(60):
        machine = stateful.FirstPerWindow(r.choice([1, 10, 60]))
        us = np.sort(np.array([r.randrange(0, r.choice([50, 400])) * 1_000_000 for _ in range(r.randint(1, 120))]))
        table = machine.exits()
        cuts = sorted({0, len(us), *[r.randrange(len(us)) for _ in range(3)]})
        for a, b in zip(cuts, cuts[1:]):
            table.feed(us[a:b])
        bounds, exits = table.result()
        for state in [None, *range(int(us[0]) - 1, int(us[0]) + int(machine.window_s * 1e6) + 1, 500_000)]:
            assert rp.JumpTable.leave(state, bounds, exits) == machine.run(state, us, {})[0]


def breaker_model(data, max_actions, window, cooldown):
    """Row by row, from the rules in words."""
    state, out = {}, {}
    for r in sorted(data, key=lambda r: (r["timestamp"], r["id"])):
        s = state.setdefault(r["service_name"], {"state": "CLOSED", "opened": None, "failures": 0, "ran": []})
        at = r["timestamp"]
        if s["state"] == "OPEN":
            if (at - s["opened"]).total_seconds() < cooldown:
                out[r["id"]] = (False, "cooldown", "OPEN", s["failures"])
                continue
            s["state"] = "HALF_OPEN"
        ran = [x for x in s["ran"] if x[0] == r["action_type"] and (at - x[1]).total_seconds() <= window]
        if len(ran) >= max_actions:
            s.update(state="OPEN", opened=at, failures=len(ran))
            out[r["id"]] = (False, "limit", "OPEN", len(ran))
            continue
        s["ran"].append((r["action_type"], at))
        if r["success"]:
            if s["state"] == "HALF_OPEN":
                s.update(state="CLOSED", opened=None, failures=0)
        else:
            s["failures"] += 1
        out[r["id"]] = (True, None, s["state"], s["failures"])
    return out


@pytest.mark.parametrize("how", [{}, {"limit": 0, "blocks": 4}, {"limit": 0, "blocks": 40}])
@pytest.mark.parametrize("rule", [(3, 300, 120), (2, 900, 60)])
def test_breaker(skewed, how, rule):
    got = stateful.breaker_replay(skewed, *rule, **how).collect()
    want = breaker_model(skewed.collect(), *rule)
    assert {r["id"]: (r["allowed"], r["denied_by"], r["breaker_state"], r["failure_count"]) for r in got} == want


def test_breaker_timeline(spark):
    at = [0, 5, 10, 15, 135, 255, 375]
    data = [(i, "s", "restart", T0 + timedelta(seconds=x), True) for i, x in enumerate(at)]
    df = spark.createDataFrame(data, "id int, service_name string, action_type string, timestamp timestamp_ntz, success boolean")
    out = stateful.breaker_replay(df).orderBy("id").collect()
    assert [r["allowed"] for r in out] == [True] * 3 + [False] * 3 + [True]
    assert out[-1]["breaker_state"] == "CLOSED" and out[3]["breaker_state"] == "OPEN"
    states = stateful.breaker_states(stateful.breaker_replay(df), "2024-01-01 00:00:45").first()
    assert (states["breaker_state"], states["cooldown_remaining_seconds"]) == ("OPEN", 90)
