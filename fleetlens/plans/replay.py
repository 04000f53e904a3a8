"""Replay of sequential rules (one state per key, rows in time order) over large tables.

A rule is a small machine: `fresh()` gives the state before the first row, `run(state, columns)` takes
the next rows of one key as numpy arrays and returns the new state and the output arrays, and
`settle(state, time)` reduces a state to what still matters at a time (None when nothing does).

Small keys: the rows are hashed by key, sorted, and each task streams its keys batch by batch.
Hot keys: the rows are range-partitioned by (key, time), so one key spans many tasks, and written once. What
remains is the state in which each block is entered:

* A machine with `exits()` describes a block as a function from the state at its entry to the one at its exit. One pass
  over the rows makes these functions, all blocks at once; composing them in order reads no rows. With the final
  pass that is three passes in all, whatever the data.
* For other machines every block is run from a fresh state, then once more from the state that the block before it
  leaves. Rules that forget are settled by then. Keys that are not pass through one task each, as a stream of the
  machine's input columns alone. With writing and the final pass that is five passes at most.

A task holds one batch of rows, and of a block's function one entry per row of its first window at most.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.plans.intervals import micros
from fleetlens.plans.ordered import BLOCK, has_hot_key, ordered_blocks
from fleetlens.session import MAX_ROWS_PER_TASK

KEY, TIME = "_key", "_us"


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate(([0], edges))
    return zip(starts.tolist(), np.concatenate((edges, [len(keys)])).tolist())


class _Stream:
    """Feeds sorted batches to a machine and keeps the state of the key at hand."""

    def __init__(self, machine, entries: dict[int, str]):
        self.machine, self.entries = machine, entries
        self.key, self.state = None, None
        self.block = self.first_key = self.first_us = None
        self.keys_seen = 0

    def feed(self, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        keys, us = pdf[KEY].to_numpy(), pdf[TIME].to_numpy()
        cols = {c: pdf[c].to_numpy() for c in self.machine.inputs}
        out = {c: [] for c in self.machine.outputs}
        for a, b in _runs(keys):
            if keys[a] != self.key:
                self.key, self.state = keys[a], self.machine.fresh()
                self.keys_seen += 1
                if self.keys_seen == 1:
                    self.first_key, self.first_us = self.key, int(us[a])
                    if BLOCK in pdf:
                        self.block = int(pdf[BLOCK].iloc[0])
                        if self.block in self.entries:
                            self.state = json.loads(self.entries[self.block])
            self.state, got = self.machine.run(self.state, us[a:b], {c: v[a:b] for c, v in cols.items()})
            for c in out:
                out[c].append(got[c])
        return {c: np.concatenate(v) for c, v in out.items()}


def _emit(machine, entries: dict[int, str], keep: list[str]):
    def work(batches):
        s = _Stream(machine, entries)
        for pdf in batches:
            if len(pdf):
                out = pdf[keep].copy()
                for c, v in s.feed(pdf).items():
                    out[c] = v
                yield out

    return work


def _scan(machine, entries: dict[int, str]):
    def work(batches):
        s = _Stream(machine, entries)
        for pdf in batches:
            if len(pdf):
                s.feed(pdf)
        if s.first_key is not None:
            yield pd.DataFrame(
                {
                    "block": [s.block], "first_key": [s.first_key], "first_us": [s.first_us],
                    "last_key": [s.key], "leaves": [json.dumps(s.state)],
                }
            )

    return work


class JumpTable:
    """The function of a block for machines whose state is a time from which rows pass again.

    Every row of the block's first window may be the first to pass. Their chains of passing rows are followed
    together; chains that meet in a row stay together from then on, so they become one. `bounds` and `exits` say:
    entered with a state up to bounds[i], the block is left with exits[i]."""

    def __init__(self, width: int):
        self.width, self.first, self.closed = width, None, False
        self.starts, self.chain, self.until = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def feed(self, us: np.ndarray) -> None:
        """The next rows of the key, in time order."""
        us = us.astype(np.int64)
        if self.first is None:
            self.first = int(us[0])
        if not self.closed:
            # Up to the first row that no state at the entry can hold back.
            end = int(np.searchsorted(us, self.first + self.width))
            self.closed = end < len(us)
            new = np.unique(us[: end + 1])
            new = new[np.searchsorted(new, self.starts[-1], "right") :] if len(self.starts) else new
            self.chain = np.concatenate((self.chain, len(self.until) + np.arange(len(new))))
            self.starts, self.until = np.concatenate((self.starts, new)), np.concatenate((self.until, new + self.width))
        self._follow(us)

    def _follow(self, us: np.ndarray) -> None:
        last = int(us[-1])
        while True:
            self.until, same = np.unique(self.until, return_inverse=True)
            self.chain = same[self.chain]
            behind = int(np.searchsorted(self.until, last, "right"))
            if not behind:
                return
            self.until[:behind] = us[np.searchsorted(us, self.until[:behind])] + self.width

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        exits = self.until[self.chain]
        ends = np.append(np.flatnonzero(exits[1:] != exits[:-1]), len(exits) - 1)
        return self.starts[ends], exits[ends]

    @staticmethod
    def leave(state: int | None, bounds: np.ndarray, exits: np.ndarray) -> int:
        """The state at the exit for the one at the entry. Without bounds it is always the same."""
        if state is None or not len(bounds):
            return int(exits[0])
        i = int(np.searchsorted(bounds, state))
        return int(exits[i]) if i < len(bounds) else state


def _tables(machine):
    """(key, block, whether its entry is asked for, time of the first row, function): one row for a block of one
    key, two for others: one asks for the entry of the first key, one tells what the last key leaves."""

    def work(batches):
        block = first = key = state = None
        table, at = machine.exits(), 0
        for pdf in batches:
            if not len(pdf):
                continue
            keys, us = pdf[KEY].to_numpy(), pdf[TIME].to_numpy()
            for a, b in _runs(keys):
                if first is None:
                    block, first, key, at = int(pdf[BLOCK].iloc[0]), keys[a], keys[a], int(us[a])
                elif keys[a] != key:
                    key, state = keys[a], machine.fresh()
                if key == first:
                    table.feed(us[a:b])
                else:
                    state, _ = machine.run(state, us[a:b], {})
        if first is None:
            return
        if key == first:
            rows = [(key, block, True, at, *table.result())]
        else:
            rows = [(first, block, True, at, [], []), (key, block, False, 0, [], [state])]
        yield pd.DataFrame(rows, columns=["key", "block", "asks", "first_us", "bounds", "exits"])

    return work


def _compose(machine):
    def work(batches):
        key = state = None
        for pdf in batches:
            found = []
            for k, block, asks, at, bounds, exits in pdf.itertuples(index=False, name=None):
                if k != key:
                    key, state = k, None
                left = machine.settle(state, at) if asks and state is not None else None
                if left is not None:
                    found.append((block, json.dumps(left)))
                if len(exits):
                    state = JumpTable.leave(left if asks else None, bounds, exits)
            if found:
                yield pd.DataFrame(found, columns=["block", "entry"])

    return work


TABLES, ENTRIES = "key string, block int, asks boolean, first_us long, bounds array<long>, exits array<long>", "block int, entry string"


def _composed_entries(slim: DataFrame, machine) -> dict[int, str]:
    """Entry states by composing the functions of the blocks of each key in order."""
    tables = slim.mapInPandas(_tables(machine), TABLES)
    in_order = tables.repartition("key").sortWithinPartitions("key", "block")
    return {r["block"]: r["entry"] for r in in_order.mapInPandas(_compose(machine), ENTRIES).collect()}


def _chain(machine):
    """The entry of every block of the keys at hand, from all their rows in order."""

    def work(batches):
        key = block = state = None
        for pdf in batches:
            if not len(pdf):
                continue
            keys, us, blocks = pdf[KEY].to_numpy(), pdf[TIME].to_numpy(), pdf[BLOCK].to_numpy()
            found = []
            for a, b in _runs(keys):
                if keys[a] != key:
                    key, block, state = keys[a], None, machine.fresh()
                cuts = [a, *(a + 1 + np.flatnonzero(blocks[a + 1 : b] != blocks[a : b - 1])).tolist(), b]
                for i, j in zip(cuts, cuts[1:]):
                    if blocks[i] != block:
                        block = blocks[i]
                        left = machine.settle(state, int(us[i]))
                        if left is not None:
                            found.append((int(block), json.dumps(left)))
                    state, _ = machine.run(state, us[i:j], {c: pdf[c].to_numpy()[i:j] for c in machine.inputs})
            if found:
                yield pd.DataFrame(found, columns=["block", "entry"])

    return work


SCAN = "block int, first_key string, first_us long, last_key string, leaves string"


def _settle_entries(slim: DataFrame, machine, rounds: int = 2) -> dict[int, str]:
    """Entry state of every block that does not start fresh. One small row per block reaches the driver."""
    if hasattr(machine, "exits"):
        return _composed_entries(slim, machine)

    def scan(entries, only=None):
        rows = slim if only is None else slim.filter(F.col(BLOCK).isin(only))
        return {r["block"]: r for r in rows.mapInPandas(_scan(machine, entries), SCAN).collect()}

    entries: dict[int, str] = {}
    seen = scan(entries)
    while True:
        rounds -= 1
        changed, before = [], None
        for b in sorted(seen):
            r, want = seen[b], None
            if before is not None and before["last_key"] == r["first_key"]:
                left = machine.settle(json.loads(before["leaves"]), r["first_us"])
                want = None if left is None else json.dumps(left)
            if entries.get(b) != want:
                changed.append(b)
                entries.pop(b, None) if want is None else entries.__setitem__(b, want)
            before = r
        if not changed:
            return entries
        if not rounds:
            break
        seen |= scan(entries, changed)
    # At most one key per block is left over.
    open_keys = sorted({seen[b]["first_key"] for b in changed})
    rest = slim.withColumn("_at", F.monotonically_increasing_id()).filter(F.col(KEY).isin(open_keys))
    told = rest.repartition(KEY).sortWithinPartitions(KEY, "_at").mapInPandas(_chain(machine), ENTRIES).collect()
    entries = {b: e for b, e in entries.items() if seen[b]["first_key"] not in open_keys}
    return entries | {r["block"]: r["entry"] for r in told}


def replay(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    machine,
    limit: int | None = MAX_ROWS_PER_TASK,
    blocks: int | None = None,
) -> DataFrame:
    """`df` with the machine's output columns; rows of one key are taken in (ts, ties) order."""
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(machine.schema).fields])
    ready = df.withColumns({KEY: F.to_json(F.struct(*keys)), TIME: micros(ts)})
    by = [TIME, *ties]
    if not has_hot_key(df, keys, limit):
        rows = ready.repartition(KEY).sortWithinPartitions(KEY, *by)
        return rows.mapInPandas(_emit(machine, {}, df.columns), schema)
    cut = ordered_blocks(ready, [KEY], by, blocks)
    entries = _settle_entries(cut.select(BLOCK, KEY, TIME, *machine.inputs), machine)
    return cut.mapInPandas(_emit(machine, entries, df.columns), schema)
