"""Paging by key, recording rules that are brought up to date, and rules from one pass over the samples."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog import timeseries as ts
from fleetlens.operators import filters as flt
from fleetlens.operators import promlike as prom
from fleetlens.sources import tables as t
from fleetlens.sources.partitions import read_table

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("down", [True, False])
def test_pages_by_key_are_the_pages_by_number(spark, down):
    rows = [(i, T0 + timedelta(minutes=i * 7 % 13)) for i in range(103)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz").repartition(5)
    keys = [("timestamp", down), ("id", not down)]
    order = [F.desc("timestamp") if down else F.asc("timestamp"), F.asc("id") if down else F.desc("id")]
    after, n = None, 0
    while True:
        got = [tuple(r) for r in flt.page_after(df, keys, 10, after).collect()]
        assert got == [tuple(r) for r in flt.page(df, order, 10, n * 10).collect()]
        if not got:
            break
        after, n = (got[-1][1], got[-1][0]), n + 1
    assert n == 11
    index = {r["page"]: (r["timestamp"], r["id"]) for r in flt.page_index(df, keys, 10).collect()}
    assert index == {k: tuple(flt.page(df, order, 1, k * 10).first()[c] for c in ("timestamp", "id")) for k in range(11)}


def test_a_late_page_is_pruned_at_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select("id", (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("double"))).alias("timestamp")).write.parquet(path)
    page = flt.page_after(spark.read.parquet(path), [("timestamp", True), ("id", True)], 10, (T0 + timedelta(seconds=20), 20))
    plan = page._jdf.queryExecution().toString()
    assert "LessThanOrEqual(timestamp" in plan and "TakeOrderedAndProject" in plan and "Offset" not in plan
    assert [r["id"] for r in page.collect()] == list(range(19, 9, -1))


def counters(spark, n):
    rows, value = [], 0
    for i in range(n):
        value = 0 if i % 17 == 0 else value + i % 5
        rows.append((i, f"s{i % 3 % 2}", T0 + timedelta(seconds=i * 47 + (2000 if i > 60 else 0)), value))
    return spark.createDataFrame(rows, "id long, series string, timestamp timestamp_ntz, value long")


def test_recording_rule_is_brought_up_to_date(spark, tmp_path):
    path, by = str(tmp_path / "rule"), ("timestamp", "id")
    rate = lambda d: prom.grid_rate(d, ["series"], 600, 60, by=by)
    seen = []

    def expr(d):
        seen.append(d.count())
        return rate(d)

    all_ = counters(spark, 120)
    for n in (40, 40, 75, 120):
        rows = all_.filter(F.col("id") < n)
        wrote = prom.update_rule(spark, path, rows, "r", expr, ["series"], 600, by)
        got = sorted((r["series"], r["timestamp"], round(r["value"], 9)) for r in read_table(spark, path).collect())
        assert got == sorted((r["series"], r["timestamp"], round(r["value"], 9)) for r in rate(rows).collect())
        assert 0 < wrote < 2 * len(got)
    assert seen[0] == 40 and all(n < 75 for n in seen[1:])  # only what the open windows touch, and a row per series
    assert prom.update_rule(spark, str(tmp_path / "none"), all_.limit(0), "r", expr, ["series"], 600, by) == 0


def test_rules_read_their_samples_once(spark, small, monkeypatch):
    """Rules of three functions and several windows: each sample is read once, whatever the rules."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        reads.add(1)
        return v

    samples = ts._samples(spark, small)
    marked = samples.withColumn("value", counted("value"))
    out = prom.evaluate_rules(marked, step=300)
    told = sorted(map(str, out.groupBy("alert", "state").count().collect()))
    wanted = {r[1] for r in prom.RULES}
    assert reads.value == samples.filter(F.col("metric").isin(*wanted)).count()
    assert told == sorted(map(str, prom.evaluate_rules(samples, step=300).groupBy("alert", "state").count().collect()))


def test_down_needs_the_job(spark):
    rows = [(T0 + timedelta(minutes=m), "up", labels, 0.0) for m in range(5) for labels in ({"job": "flask-app", "service": "a"}, {"service": "b"}, {"job": "other", "service": "c"})]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, metric string, labels map<string,string>, value double")
    got = prom.evaluate_rules(df, [r for r in prom.RULES if r[0] == "ApplicationDown"], step=60)
    assert {r["series"] for r in got.collect()} == {"job=flask-app,service=a"}
    assert {r["state"] for r in got.collect()} == {"pending", "firing"}


def test_incidents_of_every_type_count(spark, small):
    """Predictions are matched with any incident of the next hour, whatever its type."""
    from fleetlens.operators import joins as jn

    inc, pr = t.incident_events(spark, small), t.predictions(spark, small)
    all_ = jn.match_predictions(pr, inc).filter("matched").count()
    assert all_ > max(jn.match_predictions(pr, inc.filter(F.col("type") == x)).filter("matched").count() for x in ("error", "purchase"))
