"""Conversation structure repair: cheapest edits by a Viterbi search that emits what all survivors share.

States are what the last kept row was: nothing yet, a system, a user or an assistant row. Each state has one survivor,
the cheapest way to it and of equally cheap ones that with the ASCII-least edits. Survivors are leaves of a tree of
backpointers; a node counts its references, and goes with its last one. Once the root has a single child, every survivor
goes through that child, so its edit is final: it is emitted and becomes the root. The tree then holds only what is
still undecided, and ties are settled by comparing the whole undecided suffixes from the last shared node on."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm import common as c

WHITE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
#: Next state by state, for a row with this initial; a role that a row may get or that may be inserted.
_BY_INITIAL = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_GIVEN = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
_BATCH_ROWS, _BATCH_CHARS = 10_000, 4 << 20


class Turn(NamedTuple):
    """A row of a conversation as the search reads it."""

    turn: int | None
    role: str
    text: str
    fault: str | None
    illegal: bool


class Node:
    """An edit on the way of one survivor or of several."""

    __slots__ = ("parent", "edit", "role", "row", "depth", "refs")

    def __init__(self, parent: Node | None, edit: str = "", role: str = "", row: Turn | None = None):
        self.parent, self.edit, self.role, self.row = parent, edit, role, row
        self.depth, self.refs = (parent.depth + 1 if parent else 0), 0
        if parent:
            parent.refs += 1


def _release(node: Node | None) -> None:
    """Take a node that nothing refers to out of the tree, and its ancestors that only led to it."""
    while node is not None and not node.refs and node.parent is not None:
        node.parent.refs -= 1
        node = node.parent


def _less(a: Node, b: Node) -> bool:
    """Whether the edits to `a` come before those to `b`, read from the last node that both share."""
    x, y = [], []
    while a is not b:
        if a.depth >= b.depth:
            x.append(a.edit)
            a = a.parent
        else:
            y.append(b.edit)
            b = b.parent
    return x[::-1] < y[::-1]


class Search:
    """The search over one conversation, fed row by row."""

    def __init__(self):
        self.root = Node(None)
        self.root.refs = 1
        self.alive: dict[int, tuple[int, Node]] = {NOTHING: (0, self.root)}

    def _offer(self, best: dict, state: int, cost: int, parent: Node, edit: str, role: str = "", row: Turn | None = None) -> None:
        held = best.get(state)
        if held and held[0] < cost:
            return
        node = Node(parent, edit, role, row)
        if held and held[0] == cost and _less(held[1], node):
            _release(node)
            return
        node.refs += 1
        best[state] = (cost, node)
        if held:
            held[1].refs -= 1
            _release(held[1])

    def _inserted(self, alive: dict, to: tuple[int, ...]) -> dict:
        """`alive` after the inserts that may pay: one row, or two from a state without a user row."""
        best = dict(alive)
        for _, node in best.values():
            node.refs += 1
        for target in to:
            for state in list(best):
                if _GIVEN[state][0] == target:
                    cost, node = best[state]
                    self._offer(best, target, cost + COST[INSERT], node, INSERT, _GIVEN[state][1])
        return best

    @staticmethod
    def _drop(held: dict) -> None:
        for _, node in held.values():
            node.refs -= 1
            _release(node)

    @classmethod
    def _prune(cls, best: dict) -> None:
        """Let survivors go that cannot win. Whatever follows the states nothing and system can follow an assistant row
        at the same cost, but for a kept system row, which can be deleted; a user row is one insert from there."""
        cheapest = min((best[s][0] + more for s, more in ((ASSISTANT, 0), (USER, COST[INSERT])) if s in best), default=None)
        for state, more in ((NOTHING, COST[DELETE]), (SYSTEM, 0)):
            if cheapest is not None and state in best and best[state][0] > cheapest + more:
                cls._drop({state: best.pop(state)})

    def push(self, row: Turn) -> Iterator[Node]:
        """Take the next row; yield the nodes whose edits have become final."""
        # A user row inserted behind an assistant row that was itself inserted never pays, so that one round is enough.
        closed = self._inserted(self.alive, (USER, ASSISTANT))
        best: dict[int, tuple[int, Node]] = {}
        stays = COST[KEEP] + (TRUNCATED_COST if row.fault == "truncated" else 0)
        rerole = COST[REROLE] + stays
        undeletable = row.fault not in ("blank", "duplicate")
        moves = _BY_INITIAL.get(row.role[:1], {})
        for state, (cost, node) in closed.items():
            self._offer(best, state, cost + COST[DELETE], node, DELETE, "", row)
            if undeletable:
                if state in moves:
                    self._offer(best, moves[state], cost + stays, node, KEEP, row.role, row)
                target, role = _GIVEN[state]
                self._offer(best, target, cost + rerole, node, REROLE, role, row)
        self._drop(closed)
        self._drop(self.alive)
        self._prune(best)
        self.alive = best
        yield from self._settled(next(iter(best.values()))[1])

    def _settled(self, leaf: Node) -> Iterator[Node]:
        if self.root.refs != 1 or leaf is self.root:
            return
        path = []
        while leaf is not self.root:
            path.append(leaf)
            leaf = leaf.parent
        while path and self.root.refs == 1:
            self.root = path.pop()
            self.root.parent = None
            yield self.root

    def finish(self) -> Iterator[Node]:
        """The edits that were still open, at the end of the conversation."""
        best: dict[int, tuple[int, Node]] = {}
        for state, (cost, node) in self.alive.items():
            for _ in range({NOTHING: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]):
                state, role = _GIVEN[state]
                node, cost = Node(node, INSERT, role), cost + COST[INSERT]
            held = best.get(0)
            if held is None or cost < held[0] or (cost == held[0] and _less(node, held[1])):
                best[0] = (cost, node)
        path, node = [], best[0][1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        yield from reversed(path)

    def open_nodes(self) -> int:
        """How many nodes the survivors hold behind the last final edit."""
        seen = set()
        for _, node in self.alive.values():
            while node is not self.root and id(node) not in seen:
                seen.add(id(node))
                node = node.parent
        return len(seen)


def repairs(rows: Iterator[tuple[object, Turn]]) -> Iterator[tuple[object, int, Node]]:
    """(conversation, number of the edit, its node) for rows that come conversation by conversation, in order."""
    nobody = object()
    key, search, n = nobody, None, 0
    for conv, row in rows:
        if key is nobody or conv != key:
            if search:
                for node in search.finish():
                    yield key, n, node
                    n += 1
            key, search, n = conv, Search(), 0
        for node in search.push(row):
            yield key, n, node
            n += 1
    if search:
        for node in search.finish():
            yield key, n, node
            n += 1


_COLUMNS = ("turn", "role", "text", "fault", "illegal")


def _edit_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[object, Turn]]:
        for batch in batches:
            values = [batch.column(name).to_pylist() for name in ("conv_id", *_COLUMNS)]
            for conv, *row in zip(*values):
                yield conv, Turn(*row)

    out, chars = [], 0
    for conv, n, node in repairs(rows()):
        row = node.row or Turn(None, "", "", None, False)
        out.append((conv, n, node.edit, row.turn, node.role if node.edit != DELETE else row.role, row.text, row.fault, row.illegal, node.row is not None))
        chars += len(row.text)
        if len(out) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
            yield c.rows(schema, *map(list, zip(*out)))
            out, chars = [], 0
    if out:
        yield c.rows(schema, *map(list, zip(*out)))


def first_fault(role: str = "role", text: str = "text", conv: str = "conv_id", turn: str = "turn") -> Column:
    """`blank`, `duplicate`, `truncated` or null, whichever holds first."""
    seen = F.row_number().over(W.partitionBy(conv, role, text).orderBy(F.col(turn).asc_nulls_first()))
    bare = F.rtrim(F.col(text), F.lit(WHITE))
    return F.when(bare == "", "blank").when(seen > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")


def repair(turns: DataFrame) -> DataFrame:
    """One row per edit: (conv_id, step, edit, turn, role, text, fault, illegal, given).

    `edit` is K (keep), R (another role), D (delete) or I (insert), in order of `step`; together they are the cheapest
    edits after which the role initials of a conversation read `(s?(ua)+)?`, of several the ASCII-least. `role` is that
    after the edit, for D the given one; an inserted row has an empty text, no turn, and `given` false. `fault` is the
    row's first fault: blank, duplicate (role and text of an earlier row) or truncated (no end mark). `illegal` marks
    a row whose initial must not follow that of the row before it.

    Rows of a conversation are in order of turn, null first, then role, then text. Null roles and texts are one space.
    Rows with a null conv_id are one conversation. Equal rows are rows of their own, the later ones duplicates.

    The rows of a conversation pass through one task in order, as a stream: Spark sorts them, on disk if need be, and the task
    holds one batch and the edits that are not yet decided. In the worst conversations two ways stay equally good to
    the end; then these are all of its edits."""
    blank = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = rows.repartition("conv_id").withColumn("fault", first_fault())
    in_order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    initial = F.left("role", F.lit(1))
    pair = F.concat(F.lag(initial).over(W.partitionBy("conv_id").orderBy(*in_order)), initial)
    rows = rows.withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))
    rows = rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *in_order).select("conv_id", *_COLUMNS)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("illegal", pa.bool_()), ("given", pa.bool_())])

        def all_of():
            yield first
            yield from batches

        yield from _edit_rows(all_of(), schema)

    return rows.mapInArrow(run, f"conv_id {kind}, step long, edit string, turn long, role string, text string, fault string, illegal boolean, given boolean")


def edit_cost(edit: Column, fault: Column) -> Column:
    """What an edit costs."""
    price = F.when(edit == KEEP, COST[KEEP]).when(edit == REROLE, COST[REROLE]).when(edit == DELETE, COST[DELETE]).otherwise(COST[INSERT])
    return (price + F.when((edit != DELETE) & (fault == "truncated"), TRUNCATED_COST).otherwise(0)).cast("long")
