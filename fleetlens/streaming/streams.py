"""Streaming forms of detection, deduplication, the breaker and live aggregates.

Sources have timestamps without zone; watermarks need one, so `with_event_time` casts first."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.functions.numeric import fixed
from fleetlens.operators import rules
from fleetlens.operators.stateful import Breaker, FirstPerWindow, Increments
from fleetlens.schemas import BREAKER


# Groups that `drop_late` spreads its rows over.
LATE_PARTS = 1024
# Rows of one piece of a key's waiting rows.
PIECE_ROWS = 4096
# Rows of a key that are sorted together before they are cut into pieces, and read together when they are due.
SORTED_ROWS = 64 * PIECE_ROWS
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The time of the row that ends a source. Watermarks then pass every real row.
END = datetime(2200, 1, 1)


def with_event_time(df: DataFrame, ts: str = "timestamp", delay: str = "10 minutes") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def largest_disorder(table: DataFrame, ts: str = "timestamp") -> int:
    """Seconds that a row may lie behind rows of files read before its own, when a file source reads the files of
    `table` one a trigger. A watermark of that delay drops nothing.

    Files come in order of modification; those of one time may come in any order. One row per file is compared."""
    at, us = F.col("_metadata.file_modification_time"), F.unix_micros(F.col(ts).cast("timestamp"))
    files = table.groupBy(at.alias("at"), F.col("_metadata.file_path").alias("file")).agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    times = files.groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))
    earlier = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.greatest(F.max("hi").over(earlier), F.when(F.col("n") > 1, F.col("hi")))
    behind = times.select((ahead - F.col("lo")).alias("d")).agg(F.max("d").alias("d")).first()["d"]
    return max(0, -(-(behind or 0) // 1_000_000))


class _Decide(StatefulProcessor):
    """Runs a machine of `plans.replay` over the rows of one key in (time, tie) order.

    Rows wait until the watermark has passed them, so the result does not depend on how rows fall into triggers. What waits
    is kept in pieces by their first time: new rows add pieces, and a timer reads only those that are due. It reads them in
    time order, some at a time, and decides all rows before the first time of the next piece, so that a task holds
    these pieces and those that overlap them: a few for each SORTED_ROWS rows of the key."""

    def __init__(self, machine, names: list[str], fields: list[str], keep_ms: int):
        self.machine, self.names, self.fields, self.keep_ms = machine, names, fields, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.have = handle.getValueState("have", "state string, pieces long, last_us long")
        self.waiting = handle.getMapState("waiting", "first_us long, piece long", "rows binary")

    def _hold(self, rows: pd.DataFrame, n: int) -> int:
        """Keep sorted rows from piece number `n` on; the next number."""
        for at in range(0, len(rows), PIECE_ROWS):
            piece = rows.iloc[at : at + PIECE_ROWS].reset_index(drop=True)
            self.waiting.updateValue((int(piece["_us"].iloc[0]), n), (pickle.dumps(piece),))
            n += 1
        return n

    def _state(self) -> tuple[str, int, int]:
        return tuple(self.have.get()) if self.have.exists() else (json.dumps(self.machine.fresh()), 0, 0)

    def _sorted(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts, ignore_index=True).sort_values(["_us", "_tie"], kind="stable")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, n, last = self._state()
        first, parts, size = None, [], 0
        for batch in rows:
            if len(batch):
                # Spark hands over named tuples, which know no names with a leading underscore.
                parts.append(batch.set_axis(self.names, axis=1))
                size += len(batch)
                start = int(parts[-1]["_us"].min())
                first = start if first is None else min(first, start)
                if size >= SORTED_ROWS:
                    n, parts, size = self._hold(self._sorted(parts), n), [], 0
        if parts:
            n = self._hold(self._sorted(parts), n)
        self.have.update((state, n, last))
        if first is not None:
            self.handle.registerTimer(max(first // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        state, n, last = self._state()
        pieces = sorted(tuple(k) for k in self.waiting.keys())
        due = [k for k in pieces if k[0] <= now * 1000]
        if not due:
            if not pieces and now >= last // 1000 + self.keep_ms:
                self.have.clear()
            return
        state, open_, parts, size = json.loads(state), 0, [], 0
        for i, k in enumerate(due):
            parts.append(pickle.loads(self.waiting.getValue(k)[0]))
            self.waiting.removeKey(k)
            size += len(parts[-1])
            more = i + 1 < len(due)
            # Read at least as many rows as were left open, so that no row is sorted again and again.
            if more and size < open_ + max(SORTED_ROWS, open_):
                continue
            rows = self._sorted(parts)
            us = rows["_us"].to_numpy()
            ready = int(np.searchsorted(us, due[i + 1][0])) if more else int(np.searchsorted(us, now * 1000, "right"))
            parts, open_ = [rows.iloc[ready:]], len(us) - ready
            size = open_
            if ready:
                state, got = self.machine.run(state, us[:ready], {c: rows[c].to_numpy()[:ready] for c in self.machine.inputs})
                last = int(us[ready - 1])
                out = rows.iloc[:ready][self.fields].reset_index(drop=True)
                for c, v in got.items():
                    out[c] = v
                yield out
        n = self._hold(parts[0], n)
        self.have.update((json.dumps(state), n, last))
        coming = [int(us[ready])] if open_ else []
        coming += [k[0] for k in pieces[len(due) : len(due) + 1]]
        self.handle.registerTimer(max(min(coming) // 1000 + 1 if coming else last // 1000 + self.keep_ms, now + 1))

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys, ts, tie, machine, keep_s: float) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ready = df.withColumns({"_us": F.unix_micros(ts), "_tie": F.col(tie)})
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(machine.schema).fields])
    return ready.groupBy(*keys).transformWithStateInPandas(_Decide(machine, ready.columns, df.columns, int(keep_s * 1000)), schema, "append", "EventTime")


def dedupe_stream(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", window_s: float = 60, tie: str = "id") -> DataFrame:
    """Streaming `dedupe`; `df` has a watermark on `ts`. A row is decided when the watermark has passed it; what
    waits at the end of a source is decided by `drain` with an end. The rows of one key that the watermark has
    not passed are held in its state."""
    out = _run(df, keys, ts, tie, FirstPerWindow(window_s), window_s)
    return out.filter("emitted").drop("emitted")


def breaker_stream(
    df: DataFrame, max_actions=BREAKER["max_actions"], window_s=BREAKER["window_s"], cooldown_s=BREAKER["cooldown_s"],
    service="service_name", action="action_type", success="success", ts="timestamp", tie="id", keep_s: float = 86400,
) -> DataFrame:
    """Streaming `breaker_replay`, decided as in `dedupe_stream`. The state of a service is kept `keep_s` after
    its last request."""
    ready = df.withColumns({"_kind": F.col(action), "_ok": F.coalesce(F.col(success), F.lit(False))})
    out = _run(ready, [service], ts, tie, Breaker(max_actions, window_s, cooldown_s), keep_s)
    return out.withColumn("opened_at", F.timestamp_micros("opened_us")).drop("_kind", "_ok", "opened_us")


def increments_stream(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", tie: str = "id", value: str = "value", keep_s: float = 86400) -> DataFrame:
    """Streaming growth of counters: each sample with its `increment` since the former one of its series; after a
    reset the new value itself, 0 for the first sample. The last value of a series is kept `keep_s`."""
    out = _run(df.withColumn("_value", F.col(value).cast("double")), list(keys), ts, tie, Increments(), keep_s)
    return out.drop("_value")


def counter_rates(df: DataFrame, keys: Sequence[str], size_s: int = 300, slide_s: int = 30, ts: str = "timestamp", delay: str = "10 minutes") -> DataFrame:
    """Per-second growth over (t - size, t] at every grid point t whose window holds a sample, from rows with an
    `increment`. Windows end with their grid point, so a sample counts a microsecond earlier; the watermark of `delay` is
    on that time."""
    before = F.col(ts).cast("timestamp") - F.expr("interval 1 microsecond")
    w = F.window("_before", f"{size_s} seconds", f"{slide_s} seconds")
    rates = df.withColumn("_before", before).withWatermark("_before", delay).groupBy(*keys, w.alias("w")).agg((F.sum("increment") / F.lit(float(size_s))).alias("value"))
    return rates.select(*keys, F.col("w.end").alias("timestamp"), "value")


def match_stream(left: DataFrame, inc: DataFrame, keys: Sequence[str], row_id: Sequence[str], back_s: float, ahead_s: float, ts: str = "timestamp") -> DataFrame:
    """Streaming `exists_between`: row_id, keys, `ts` and `matched`, for rows of `left` that meet a row of `inc` of the same
    keys in [t - back, t + ahead]. Both sides have a watermark.

    Time is cut into cells of the interval's length, so that a row of `left` looks into two of them: windows of two cells,
    one beginning with each cell, keep only the latest time of their first cell and the earliest of their second, which
    decide. So a left row meets one row at most, however many partners it has. A window goes out when the watermark has
    passed it; a left row waits for the window of its cell and goes out unmatched where there is none."""
    us = lambda s: int(s * 1_000_000)
    width, at = us(back_s + ahead_s), F.unix_micros(ts)
    middle = F.unix_micros("_w.start") + width
    pairs = inc.select(*keys, ts, F.window(ts, f"{2 * width} microseconds", f"{width} microseconds").alias("_w"))
    ends = pairs.groupBy(*keys, "_w").agg(F.max(F.when(at < middle, at)).alias("_last"), F.min(F.when(at >= middle, at)).alias("_first"))
    b = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.window_time("_w").alias("_at"), F.unix_micros("_w.start").alias("_start"), "_last", "_first").alias("b")
    lo = at - us(back_s)
    a = left.select(*row_id, *keys, ts, lo.alias("_lo"), (F.floor(lo / F.lit(width)) * width).alias("_cell")).alias("a")
    cond = F.col("_cell") == F.col("_start")
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"_k_{k}"))
    # Follows from equal cells; tells Spark how long a row can wait for a window.
    near = F.expr(f"_at >= a.{ts} + interval {us(ahead_s)} microseconds and _at <= a.{ts} + interval {width + us(ahead_s)} microseconds")
    out = a.join(b, cond & near, "left_outer")
    hit = F.coalesce(F.col("_last") >= F.col("_lo"), F.lit(False)) | F.coalesce(F.col("_first") <= F.col("_lo") + width, F.lit(False))
    return out.select(*[F.col(f"a.{c}").alias(c) for c in (*row_id, *keys, ts)], hit.alias("matched"))


def matched_rows(found: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """One row for each row of the left side, from the rows that `match_stream` has written."""
    rest = [c for c in found.columns if c not in (*row_id, "matched")]
    out = found.groupBy(*row_id).agg(*[F.first(c).alias(c) for c in rest], F.max("matched").alias("matched"))
    return out.where(F.col(row_id[0]).isNotNull())


def valid_versions(df: DataFrame, versions: DataFrame, keys: Sequence[str], ts: str = "timestamp", since: str = "valid_from") -> DataFrame:
    """Each row with the version of its keys that is valid at its time: the latest that began at or before it, null where
    there is none yet. A key has few versions."""
    w = Window.partitionBy(*keys).orderBy(since)
    value = [c for c in versions.columns if c not in (*keys, since)]
    spans = versions.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(since).alias("_since"), F.lead(since).over(w).alias("_until"), *value)
    cond = (F.col(ts) >= F.col("_since")) & (F.col("_until").isNull() | (F.col(ts) < F.col("_until")))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return df.join(spans, cond, "left").select(*[df[c] for c in df.columns], *value)


def versioned_sink(path: str, read_versions, keys: Sequence[str], ts: str = "timestamp", then=None):
    """A `foreachBatch` writer that adds the settings valid at the time of each row. `read_versions(spark)` is called for every
    batch, so a version that is stored while the stream runs holds from the next batch on, for the rows that it is
    about. `then` takes the joined rows before they are written. A repeated batch replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = valid_versions(batch, read_versions(batch.sparkSession), keys, ts)
        (then(out) if then else out).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def live_metrics(df: DataFrame, size: str = "2 seconds", keys: Sequence[str] = ("service_name",), ts: str = "timestamp") -> DataFrame:
    """Means and error rate of each tumbling window; `df` has a watermark and the columns value, type."""
    errors = F.count_if(F.col("type") == "error")
    return df.groupBy(*keys, F.window(ts, size).alias("w")).agg(
        F.count("*").alias("total_requests"),
        errors.alias("total_errors"),
        fixed(F.avg("value"), 2).alias("avg_value"),
        fixed(errors / F.count("*"), 4).alias("error_rate"),
    ).select(*keys, F.col("w.start").alias("window_start"), "total_requests", "total_errors", "avg_value", "error_rate")


def sliding_rates(df: DataFrame, size_s: int = 300, slide_s: int = 30, keys: Sequence[str] = ("service_name", "type"), ts: str = "timestamp") -> DataFrame:
    """Events per second in sliding windows; `df` has a watermark."""
    w = F.window(ts, f"{size_s} seconds", f"{slide_s} seconds")
    return df.groupBy(*keys, w.alias("w")).agg((F.count("*") / F.lit(float(size_s))).alias("rate")).select(
        *keys, F.col("w.end").alias("timestamp"), "rate"
    )


def drop_late(df: DataFrame, ts: str = "timestamp", delay: str = "168 hours", ids: Sequence[str] = ("id",)) -> DataFrame:
    """Rows not older than `delay` behind the newest time of earlier triggers; rows that repeat an id stay.

    Spark keeps rows behind the watermark from a state function, and this one passes the others on without
    keeping a state. `ids` only spread the rows over tasks."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    spread = timed.withColumn("_part", F.pmod(F.xxhash64(*ids), F.lit(LATE_PARTS)))

    names = timed.columns

    def work(key, batches: Iterator[pd.DataFrame], state: GroupState):
        for b in batches:
            yield b[names]

    return spread.groupBy("_part").applyInPandasWithState(work, timed.schema, "none int", "append", GroupStateTimeout.EventTimeTimeout)


def incident_sink(path: str):
    """A `foreachBatch` writer that replaces the folder of its batch, so a repeated batch adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def detections(df: DataFrame, delay: str = "10 minutes", window_s: float = 60, end: str | None = None) -> DataFrame:
    """Health rows to deduplicated incidents with their actions, on a stream; `end` as in `drain`."""
    found = rules.detect_all(df)
    timed = with_event_time(until_end(found, end) if end else found, "timestamp", delay)
    fresh = dedupe_stream(timed, ["service_name", "type"], window_s=window_s, tie="severity")
    return rules.choose_action(fresh)


def detection_stream(df: DataFrame, sink: str, checkpoint: str, delay: str = "10 minutes", window_s: float = 60, trigger: dict | None = None):
    """Start the detection job: source frame to incident table. `trigger` is that of `writeStream`."""
    out = detections(df, delay, window_s).writeStream.foreachBatch(incident_sink(sink))
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def until_end(df: DataFrame, folder: str) -> DataFrame:
    """The stream `df` with a second source behind it, the folder in which `drain` puts the row that ends it. Goes before
    the watermark."""
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.parquet(folder)
    return df.unionByName(spark.readStream.schema(df.schema).parquet(folder))


def end_source(spark: SparkSession, folder: str, ts: str = "timestamp") -> None:
    """Add the row that ends a source: its time lies far ahead, texts say `end`, all else is null. Texts are not
    null, since a join on them would leave the row out before it reaches the watermark."""
    def value(f: T.StructField):
        return F.lit(END) if f.name == ts else F.lit("end") if isinstance(f.dataType, T.StringType) else F.lit(None)

    row = [value(f).cast(f.dataType).alias(f.name) for f in spark.read.parquet(folder).schema]
    spark.range(1).select(*row).write.mode("append").parquet(folder)


def dropped_rows(query) -> int:
    """Rows that a stopped query dropped because they came behind its watermark."""
    return sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)


def drain(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", end: str | Sequence[str] | None = None, may_drop: bool = True) -> DataFrame:
    """Run a stream over all there is and return what it wrote. With `end`, the folder (or folders) given to `until_end`,
    the sources are then ended, all in one run since a restart knows one watermark only: rows that still wait are decided and open windows closed, and the checkpoint takes no more rows.
    Without `may_drop` it is an error if a row was dropped as late."""

    def run() -> int:
        q = df.writeStream.outputMode(mode).foreachBatch(incident_sink(sink)).option("checkpointLocation", checkpoint)
        q = q.trigger(availableNow=True).start()
        q.awaitTermination()
        return dropped_rows(q)

    lost = run()
    if end is not None:
        for folder in [end] if isinstance(end, str) else end:
            end_source(df.sparkSession, folder)
        lost += run()
    if lost and not may_drop:
        raise ValueError(f"{lost} rows came behind the watermark; take a longer delay, see largest_disorder")
    return read_sink(df.sparkSession, sink)
