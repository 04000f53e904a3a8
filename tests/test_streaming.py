"""Streams drained to a table must equal their batch twins."""

import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators import promlike as prom
from fleetlens.operators import rules, stateful
from fleetlens.plans.intervals import exists_between
from fleetlens.sources import tables as t
from fleetlens.streaming import streams as st


@pytest.fixture(scope="module")
def feed(spark, small, tmp_path_factory):
    """Events in time order, one file per tenth, so that a stream needs ten triggers."""
    path = str(tmp_path_factory.mktemp("feed"))
    e = t.incident_events(spark, small).orderBy("timestamp", "id")
    n = e.count()
    rows = e.withColumn("part", F.floor((F.col("id") * 10) / n))
    for i in range(10):
        rows.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path, e


def stream(spark, feed):
    return spark.readStream.schema(feed[1].schema).option("maxFilesPerTrigger", 1).parquet(feed[0])


def dirs(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "ckpt")


@pytest.fixture(scope="module")
def shuffled(spark, small, tmp_path_factory):
    """Events in twelve files out of time order: each row up to 50 minutes behind rows of an earlier file."""
    path = str(tmp_path_factory.mktemp("shuffled"))
    e = t.incident_events(spark, small)
    late = F.unix_seconds(F.col("timestamp").cast("timestamp")) + F.pmod(F.xxhash64("id"), F.lit(3000))
    rows = e.withColumn("part", F.ntile(12).over(Window.orderBy(late, "id"))).cache()
    for i in range(1, 13):
        rows.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the source orders files by their time in seconds
    return path, e


def timed(source, end, delay="10 minutes"):
    return st.with_event_time(st.until_end(source, str(end)), delay=delay)


def test_dedupe(spark, feed, tmp_path):
    live = st.dedupe_stream(timed(stream(spark, feed), tmp_path / "end"), ["type"], window_s=3600)
    got = st.drain(live, *dirs(tmp_path), end=str(tmp_path / "end"))
    want = stateful.dedupe(feed[1], ["type"], window_s=3600)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


@pytest.mark.parametrize("files", [1, 100])
def test_triggers_do_not_matter(spark, shuffled, tmp_path, files):
    """Rows out of order within the watermark, one file a trigger or all at once: the batch result either way."""
    source = lambda end: timed(spark.readStream.schema(shuffled[1].schema).option("maxFilesPerTrigger", files).parquet(shuffled[0]), end, "1 hour")
    a, c = str(tmp_path / "end-a"), str(tmp_path / "end-c")
    got = st.drain(st.dedupe_stream(source(a), ["type"], window_s=600), str(tmp_path / "a"), str(tmp_path / "b"), end=a, may_drop=False)
    want = stateful.dedupe(shuffled[1], ["type"], window_s=600)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
    got = st.drain(st.breaker_stream(requests(source(c)), 3, 36000, 3600), str(tmp_path / "c"), str(tmp_path / "d"), end=c, may_drop=False)
    want = stateful.breaker_replay(requests(shuffled[1]), 3, 36000, 3600)
    key = ("id", "allowed", "denied_by", "breaker_state", "failure_count")
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


@pytest.fixture(scope="module")
def unordered(spark, small, tmp_path_factory):
    """Events in four files, each with rows of the whole time, and one file of the first day at the end."""
    path = str(tmp_path_factory.mktemp("unordered"))
    e = t.incident_events(spark, small)
    first = e.agg(F.min("timestamp") + F.expr("interval 1 day")).first()[0]
    part = F.when(F.col("timestamp") < F.lit(first), 4).otherwise(F.pmod(F.xxhash64("id"), F.lit(4)))
    for i in range(5):
        e.filter(part == i).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path, e


def test_unordered_files_lose_nothing(spark, unordered, tmp_path):
    """With the delay that the files ask for, one a trigger gives the batch result; with ten minutes rows are lost, and said to be."""
    path, e = unordered
    delay = st.largest_disorder(spark.read.parquet(path))
    span = e.agg(F.max("timestamp") - F.min("timestamp")).first()[0].total_seconds()
    assert 0.9 * span < delay <= span + 1
    source = lambda end, d: timed(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path), end, d)
    end = str(tmp_path / "end")
    got = st.drain(st.dedupe_stream(source(end, f"{delay} seconds"), ["type"], window_s=600), *dirs(tmp_path), end=end, may_drop=False)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in stateful.dedupe(e, ["type"], window_s=600).collect())
    end = str(tmp_path / "end2")
    live = st.live_metrics(source(end, f"{delay} seconds"), "1 hour")
    got = st.drain(live, str(tmp_path / "o2"), str(tmp_path / "c2"), end=end, may_drop=False)
    assert got.agg(F.sum("total_requests")).first()[0] == e.count()
    end = str(tmp_path / "end3")
    with pytest.raises(ValueError, match="behind the watermark"):
        st.drain(st.dedupe_stream(source(end, "10 minutes"), ["type"], window_s=600), str(tmp_path / "o3"), str(tmp_path / "c3"), end=end, may_drop=False)


def test_disorder_of_ordered_files_is_small(spark, feed):
    """Files written one after another in time order; those of one modification time may come in any order."""
    assert st.largest_disorder(spark.read.parquet(feed[0])) < 40 * 86400
    assert st.largest_disorder(spark.read.parquet(feed[0]).limit(0)) == 0


def test_counter_rates(spark, small, tmp_path):
    """Growth of counters with resets over several triggers, then windows: the grid of the batch operator."""
    keys = ["service", "event_type", "status"]
    c = t.counters(spark, small)
    src = str(tmp_path / "samples")
    c.repartition(6, "event_id").write.parquet(src)
    samples = spark.read.parquet(src)
    end = str(tmp_path / "end")
    live = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 2).parquet(src)
    live = st.increments_stream(timed(live, end, f"{st.largest_disorder(samples)} seconds"), keys, tie="event_id")
    grown = st.drain(live, *dirs(tmp_path), end=end, may_drop=False)
    want = prom.increments(c, keys, ("timestamp", "event_id"))
    told = lambda df: sorted((r["event_id"], float(r["increment"])) for r in df.collect())
    assert told(grown) == told(want) and any(r["value"] == 0 for r in c.collect())
    rates = st.counter_rates(grown, keys, 3600, 600)
    got = sorted((r["service"], r["event_type"], str(r["timestamp"]), round(r["value"], 9)) for r in rates.collect())
    want = prom.grid_rate(c, keys, 3600, 600, by=("timestamp", "event_id"))
    assert got == sorted((r["service"], r["event_type"], str(r["timestamp"]), round(r["value"], 9)) for r in want.collect())


def test_waiting_rows_are_read_in_pieces(spark, monkeypatch, tmp_path):
    """A key with more rows than a piece, rows beyond the watermark among them: decided as the batch decides."""
    monkeypatch.setattr(st, "PIECE_ROWS", 16)
    src = str(tmp_path / "src")
    t0 = datetime(2024, 1, 1)
    rows = [(i, "k", t0 + timedelta(seconds=7 * i + i % 3)) for i in range(600)]
    for part in range(3):
        spark.createDataFrame(rows[part::3][:150] if part < 2 else rows[2::3] + rows[0::3][150:] + rows[1::3][150:], "id long, type string, timestamp timestamp_ntz").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    all_ = spark.read.parquet(src)
    end = str(tmp_path / "end")
    live = spark.readStream.schema(all_.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = st.drain(st.dedupe_stream(timed(live, end, f"{st.largest_disorder(all_)} seconds"), ["type"], window_s=60), *dirs(tmp_path), end=end, may_drop=False)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in stateful.dedupe(all_, ["type"], window_s=60).collect())


class Kept(dict):
    """The state of one key, as `StatefulProcessorHandle` gives it."""

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def exists(self):
        return "have" in self

    def get(self):
        return self["have"]

    def update(self, value):
        self["have"] = value

    def keys(self):
        return [k for k in super().keys() if k != "have"]

    getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.__delitem__

    def registerTimer(self, at):
        self.timer = at

    def getCurrentWatermarkInMs(self):
        return self.now


def decided(monkeypatch, machine, rows, now_ms):
    """The frames that `_Decide` gives for rows out of order in batches of 50, at the watermarks `now_ms`."""
    monkeypatch.setattr(st, "PIECE_ROWS", 8)
    monkeypatch.setattr(st, "SORTED_ROWS", 512, raising=False)
    kept = Kept()
    kept.now = 0
    work = st._Decide(machine, [*rows.columns], ["id"], 1000)
    work.init(kept)
    mixed = rows.sample(frac=1, random_state=5)
    assert not [*work.handleInputRows(("k",), (mixed[i : i + 50] for i in range(0, len(mixed), 50)), kept)]
    out = []
    for kept.now in now_ms:
        out += work.handleExpiredTimer(("k",), kept, None)
    return out, kept


def test_a_task_holds_few_of_the_waiting_rows_of_a_breaker(monkeypatch):
    """4,000 rows out of order, due at two watermarks: decided some at a time, as one run over all decides."""
    machine = stateful.Breaker(3, 40, 15)
    rows = pd.DataFrame({"id": range(4000), "_kind": "restart", "_ok": [i % 5 > 1 for i in range(4000)], "_us": [i // 2 * 1_000_000 for i in range(4000)], "_tie": range(4000)})
    out, kept = decided(monkeypatch, machine, rows, [1_499_000, 1_999_000])
    assert max(map(len, out)) < 1200 and sum(len(o) for o in out) == 4000 and not kept.keys()
    got = pd.concat(out, ignore_index=True)
    want = machine.run(machine.fresh(), rows["_us"].to_numpy(), {c: rows[c].to_numpy() for c in machine.inputs})[1]
    assert got["id"].tolist() == rows["id"].tolist()
    for c, v in want.items():
        assert got[c].tolist() == list(v)


def test_a_task_holds_few_of_the_waiting_rows_of_a_key(monkeypatch):
    """Rows of one time stay together, and those beyond the watermark wait."""
    machine = stateful.FirstPerWindow(7)
    rows = pd.DataFrame({"id": range(3000), "_us": [i // 3 * 1_000_000 for i in range(3000)], "_tie": range(3000)})
    out, kept = decided(monkeypatch, machine, rows, [899_500])
    assert max(map(len, out)) < 1200 and kept.timer == 900_001 and kept.keys()
    got = pd.concat(out, ignore_index=True)
    assert got["id"].tolist() == [*range(2700)]
    assert got["emitted"].tolist() == [i % 21 == 0 for i in range(2700)]


def requests(df):
    return df.select("id", "timestamp", "service_name", F.lit("restart").alias("action_type"), (F.col("value") < 30).alias("success"))


def test_breaker(spark, feed, tmp_path):
    end = str(tmp_path / "end")
    live = st.breaker_stream(timed(requests(stream(spark, feed)), end), 3, 36000, 3600)
    got = st.drain(live, *dirs(tmp_path), end=end)
    want = stateful.breaker_replay(requests(feed[1]), 3, 36000, 3600)
    key = ("id", "allowed", "denied_by", "breaker_state", "failure_count")
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


def test_live_metrics(spark, feed, tmp_path):
    end = str(tmp_path / "end")
    live = st.live_metrics(timed(stream(spark, feed), end, "1 hour"), "1 hour")
    got = {(r["service_name"], r["window_start"]): r["total_requests"] for r in st.drain(live, *dirs(tmp_path), end=end).collect()}
    batch = st.live_metrics(feed[1].withColumn("timestamp", F.col("timestamp").cast("timestamp")), "1 hour")
    assert got == {(r["service_name"], r["window_start"]): r["total_requests"] for r in batch.collect()}


def test_sliding_rates(spark, feed, tmp_path):
    end = str(tmp_path / "end")
    live = st.sliding_rates(timed(stream(spark, feed), end, "1 hour"), 7200, 3600, ["service_name"])
    got = {(r["service_name"], r["timestamp"]): r["rate"] for r in st.drain(live, *dirs(tmp_path), end=end).collect()}
    batch = st.sliding_rates(feed[1].withColumn("timestamp", F.col("timestamp").cast("timestamp")), 7200, 3600, ["service_name"])
    assert got == {(r["service_name"], r["timestamp"]): r["rate"] for r in batch.collect()}


def test_late_rows_drop(spark, tmp_path):
    t0 = datetime(2024, 1, 20)
    src = str(tmp_path / "src")
    schema = "id long, timestamp timestamp_ntz"
    for part in ([(1, t0)], [(2, t0 + timedelta(hours=1))], [(3, t0 - timedelta(hours=200)), (4, t0 - timedelta(hours=100)), (1, t0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # the source orders files by their time in seconds
    live = st.drop_late(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    got = sorted(r["id"] for r in st.drain(live, *dirs(tmp_path)).collect())
    assert got == [1, 1, 2, 4]


def test_detection_stream(spark, small, tmp_path):
    m = t.metrics_wide(spark, small)
    src = str(tmp_path / "metrics")
    m.orderBy("timestamp").coalesce(1).write.parquet(src)
    end = str(tmp_path / "end")
    got = st.drain(st.detections(spark.readStream.schema(m.schema).parquet(src), window_s=7200, end=end), *dirs(tmp_path), end=end)
    sink, ckpt = str(tmp_path / "open"), str(tmp_path / "open-ckpt")
    st.detection_stream(spark.readStream.schema(m.schema).parquet(src), sink, ckpt, window_s=7200).awaitTermination()
    assert 0 < st.read_sink(spark, sink).count() <= got.count()  # without an end the last rows wait
    want = stateful.dedupe(rules.detect_all(m), ["service_name", "type"], window_s=7200, ties=("severity",))
    key = ("service_name", "type", "severity", "timestamp")
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.withColumn("timestamp", F.col("timestamp").cast("timestamp")).select(*key).collect()))
    assert got.filter(F.col("action_type").isNull()).isEmpty()


def test_sink_repeats_batch(spark, tmp_path):
    write = st.incident_sink(str(tmp_path / "s"))
    df = spark.range(5)
    write(df, 0), write(df, 0), write(df, 1)
    assert st.read_sink(spark, str(tmp_path / "s")).count() == 10


def test_matches_of_two_streams(spark, small, unordered, tmp_path):
    """Rows of both sides out of order over several triggers: the answer of the batch operator, also without a partner."""
    path, e = unordered
    delay = f"{st.largest_disorder(spark.read.parquet(path))} seconds"
    a, b = str(tmp_path / "end"), str(tmp_path / "end-right")
    rows = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)
    left = timed(rows().where("value > 50").select("id", "service_name", "timestamp"), a, delay)
    right = timed(rows().where("type = 'error'").select("service_name", "timestamp"), b, delay)
    live = st.match_stream(left, right, ["service_name"], ["id"], 600, 60)
    got = st.matched_rows(st.drain(live, *dirs(tmp_path), end=[a, b], may_drop=False), ["id"])
    errors, rows = e.where("type = 'error'"), e.where("value > 50")
    ts = F.col("timestamp")
    want = exists_between(rows, errors, ["service_name"], ts - F.expr("interval 600 seconds"), ts + F.expr("interval 60 seconds"), "timestamp", 660_000_000, "matched")
    got = {r["id"]: r["matched"] for r in got.collect()}
    assert got == {r["id"]: r["matched"] for r in want.collect()} and set(got.values()) == {True, False}


def matches_written(spark, tmp_path, left, right, back_s, ahead_s):
    """Rows that `match_stream` writes for seconds of left and right rows."""
    t0, schema = datetime(2024, 1, 1), "id long, timestamp timestamp_ntz"
    ends, sides = [], []
    for name, seconds in (("left", left), ("right", right)):
        src = str(tmp_path / name)
        spark.createDataFrame([(i, t0 + timedelta(seconds=x)) for i, x in enumerate(seconds)], schema).coalesce(1).write.parquet(src)
        ends.append(str(tmp_path / f"end-{name}"))
        sides.append(timed(spark.readStream.schema(schema).parquet(src), ends[-1], "1 hour"))
    live = st.match_stream(*sides, [], ["id"], back_s, ahead_s)
    rows = st.drain(live, *dirs(tmp_path), end=ends, may_drop=False).where("id is not null").collect()
    return sorted((r["id"], r["matched"]) for r in rows)


def test_matches_list_no_pairs(spark, tmp_path):
    """One row for each left row, however many partners it has; both ends of the hour ahead count."""
    left, right = [*range(0, 400, 2), 9000, 20000, 20001], [*range(200, 300), 12600, 23601, 23601]
    assert matches_written(spark, tmp_path, left, right, 0, 3600) == [(i, x < 300 or x in (9000, 20001)) for i, x in enumerate(left)]


def test_matches_on_both_sides_list_no_pairs(spark, tmp_path):
    """Partners before and after a row, exactly ten minutes away and one second more."""
    left, right = [*range(5000, 5300, 3), 6000, 6900, 6901, 30000], [*range(5000, 5100), 7500, 29399, 30601]
    want = [(i, any(abs(x - y) <= 600 for y in right)) for i, x in enumerate(left)]
    assert matches_written(spark, tmp_path, left, right, 600, 600) == want and {w[1] for w in want} == {True, False}


def test_versions_change_between_triggers(spark, tmp_path):
    """A limit stored while the stream runs holds for the next batch; rows from before it keep theirs."""
    t0 = datetime(2024, 1, 1)
    src, limits, out, state = (str(tmp_path / n) for n in ("src", "limits", "out", "state"))
    schema = "service_name string, timestamp timestamp_ntz"
    rows = lambda hours: spark.createDataFrame([("a", t0 + timedelta(hours=h)) for h in hours] + [("b", t0)], schema).coalesce(1).write.mode("append").parquet(src)
    put = lambda h, v: spark.createDataFrame([("a", t0 + timedelta(hours=h), v)], "service_name string, valid_from timestamp_ntz, cpu_limit double").write.mode("append").parquet(limits)

    def run():
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        sink = st.versioned_sink(out, lambda s: s.read.parquet(limits), ["service_name"])
        live.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    put(1, 50.0)
    rows([0, 1, 5])
    run()
    put(4, 60.0)
    rows([2, 4, 6])
    run()
    got = sorted((r["service_name"], (r["timestamp"] - t0).seconds // 3600, r["cpu_limit"]) for r in st.read_sink(spark, out).collect() if r["service_name"] == "a")
    assert got == [("a", 0, None), ("a", 1, 50.0), ("a", 2, 50.0), ("a", 4, 60.0), ("a", 5, 50.0), ("a", 6, 60.0)]
    assert [r["cpu_limit"] for r in st.read_sink(spark, out).where("service_name = 'b'").collect()] == [None, None]
