"""Best-fit packing by a configuration linear program over the histogram of lengths.

A configuration is what one sequence may hold: numbers of pieces of each length. The covering program, whose
solution says how often each configuration is used, is solved by multiplicative weights: each round prices the
lengths and a knapsack finds the configuration of greatest price. Lengths enter in classes. The solution is rounded down and its
classes are replaced by their longest pieces, but for the last place of a sequence, which takes the longest piece that fits.
Sequences that this fills to the end are kept, and all other pieces are filled in best-fit. The histogram has at most
`capacity` numbers, so all this is small whatever the corpus."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import common as c
from fleetlens.session import durable

CAPACITY = 4096
END_ID = 1
#: Words whose ids a Python worker keeps at hand; longer words are not kept.
CACHED_WORDS, CACHED_CHARS = 900_000, 40
#: Classes of lengths in the program, rounds of the solver, and the share of its scarcest class a round may cover.
CLASSES, ROUNDS, EPSILON = 96, 2000, 0.1
#: The least pieces, as parts of the capacity, that the program decides on; tried in this order. Above 1: none.
LEAST = (0, 1 / 8, 1 / 4, 2)
#: Tokens that a sequence of the program may leave free.
WASTE = 0
_PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("tokens", pa.binary())])


class _Words(dict):
    """Token ids, as bytes, of words between blanks. Tokens never reach over white space in these vocabularies.

    A word of plain Latin letters, perhaps with marks behind it, is what the pre-tokenizer makes of it: its lower
    case and the marks. The model takes such parts as they are, and they are kept for other words; any other
    word goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)").fullmatch

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHED_CHARS:
            return self.whole(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        parts = self.plain(word)
        if not parts:
            ids = self.whole(word)
        elif parts[2]:
            ids = self[parts[1]] + self[parts[2]]
        elif (lower := parts[1].lower()) != word:
            ids = self[lower]
        else:
            letters = word if word.isascii() else self.tokenizer.pre_tokenizer.pre_tokenize_str(word)[0][0]
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        self[word] = ids
        return ids

    def whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


_WORDS: dict[str, _Words] = {}


def token_ids(text: str, path: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit numbers."""
    words = _WORDS.get(path) or _WORDS.setdefault(path, _Words(path))
    return b"".join(map(words.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def _cut(path: str, capacity: int, with_tokens: bool):
    end = np.array([END_ID], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.steps(batches):
            out = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = token_ids(text, path) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_tokens else None))
            yield c.rows(_PIECE, *zip(*out))

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_tokens: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, tokens) of every document's token ids and the end id."""
    c.bounded_batches(docs.sparkSession)
    schema = "id long, piece int, start long, length long, ids_crc32 long, tokens binary"
    return c.texts_of(docs, id_col, text_col).mapInArrow(_cut(path, capacity, with_tokens), schema)


def best_configuration(prices: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of greatest price; prices[l] for a piece of length l, at most most[l] of them.

    Each length comes in bundles of 1, 2, 4 ... pieces, so that a bundle is one step over all rooms at once."""
    bundles = []
    for length in np.flatnonzero(prices > 0):
        left, size = min(int(most[length]), capacity // int(length)), 1
        while left > 0:
            size = min(size, left)
            bundles.append((int(length), size, float(prices[length]) * size))
            left, size = left - size, 2 * size
    value = np.zeros(capacity + 1)
    taken = np.zeros((len(bundles), capacity + 1), bool)
    for i, (length, size, worth) in enumerate(bundles):
        w = length * size
        with_it = value[: capacity + 1 - w] + worth
        np.greater(with_it, value[w:], out=taken[i, w:])
        value[w:] = np.maximum(value[w:], with_it)
    out: dict[int, int] = defaultdict(int)
    room = capacity
    for i in range(len(bundles) - 1, -1, -1):
        if taken[i, room]:
            length, size, _ = bundles[i]
            out[length] += size
            room -= length * size
    return dict(out)


def classes_of(histogram: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """Upper ends of classes of lengths with about equal numbers of pieces; each piece counts as its class's end."""
    lengths = np.flatnonzero(histogram)
    share = np.cumsum(histogram[lengths]) / histogram.sum()
    cuts = np.searchsorted(share, np.arange(1, most + 1) / most - 1e-12)
    return np.unique(lengths[np.minimum(cuts, len(lengths) - 1)])


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, epsilon: float = EPSILON) -> list[tuple[dict[int, int], float]]:
    """Configurations of the `sizes` and how often to use each, so that together they cover `demand`."""
    most, prices = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1)
    most[sizes] = demand
    weight, covered = np.zeros(len(sizes)), np.zeros(len(sizes))
    at = {int(v): i for i, v in enumerate(sizes)}
    found: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        open_ = covered < demand
        if not open_.any():
            break
        prices[sizes] = np.where(open_, np.exp(weight - weight[open_].max()) / demand, 0.0)
        best = best_configuration(prices, most, capacity)
        step = epsilon * min(demand[at[k]] / v for k, v in best.items())
        found[tuple(sorted(best.items()))] += step
        for k, v in best.items():
            gain = step * v / demand[at[k]]
            covered[at[k]] += step * v
            weight[at[k]] -= gain
    return [(dict(k), v) for k, v in found.items()]


def _longest(left: np.ndarray, contents: dict[int, int], low: int, high: int) -> int:
    """The longest length in low..high of which `left` has a piece beyond those in `contents`; 0 if there is none."""
    free = left[low : high + 1].copy()
    for length, v in contents.items():
        if low <= length <= high:
            free[length - low] -= v
    at = np.flatnonzero(free > 0)
    return low + int(at[-1]) if len(at) else 0


def _round(left: np.ndarray, sizes: np.ndarray, low: int, config: dict[int, int], capacity: int, waste: int) -> tuple[dict[int, int], int]:
    """Lengths for a configuration and how many sequences `left` can fill with them; none if more than `waste` tokens
    would stay free. Each class gives its longest piece; the last place takes the longest piece at all that fits."""
    contents: dict[int, int] = defaultdict(int)
    room = capacity
    places_ = sorted((k for k, v in config.items() for _ in range(v)), reverse=True)
    for i, end in enumerate(places_):
        if i < len(places_) - 1:
            at = int(np.searchsorted(sizes, end))
            length = _longest(left, contents, max(int(sizes[at - 1]) + 1 if at else 1, low), min(end, room))
        else:
            length = _longest(left, contents, 1, room)
        if not length:
            return {}, 0
        contents[length] += 1
        room -= length
    if room > waste:
        return {}, 0
    return dict(contents), min(int(left[length]) // v for length, v in contents.items())


def by_program(left: np.ndarray, least: int, capacity: int, waste: int = WASTE) -> list[tuple[dict[int, int], int]]:
    """Sequences that the program over pieces of `least` tokens or more decides; their pieces leave `left`."""
    part = left.copy()
    part[:least] = 0
    if not part.any():
        return []
    sizes = classes_of(part)
    demand = np.bincount(np.searchsorted(sizes, np.arange(len(part))), weights=part, minlength=len(sizes))[: len(sizes)]
    out = []
    for config, times in sorted(solve(sizes, demand, capacity), key=lambda x: -x[1]):
        todo = int(times)
        while todo > 0:
            contents, k = _round(left, sizes, least, config, capacity, waste)
            if not k:
                break
            k = min(k, todo)
            for length, v in contents.items():
                left[length] -= v * k
            out.append((contents, k))
            todo -= k
    return out


def fill(plan: list[tuple[dict[int, int], int]], left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """`plan` with all pieces of `left` put in by best fit, longest first. Sequences alike are one entry."""
    rooms: dict[int, list] = defaultdict(list)
    for contents, k in plan:
        rooms[capacity - sum(length * v for length, v in contents.items())].append((contents, k))
    for length in map(int, np.flatnonzero(left)[::-1]):
        todo = int(left[length])
        while todo:
            room = next((r for r in range(length, capacity + 1) if rooms.get(r)), None)
            contents, k = rooms[room].pop() if room else ({}, todo)
            each = min((room or capacity) // length, todo)
            take = min(k, todo // each)
            if room and take < k:
                rooms[room].append((contents, k - take))
            rooms[(room or capacity) - each * length].append((contents | {length: contents.get(length, 0) + each}, take))
            todo -= each * take
    return [(contents, k) for group in rooms.values() for contents, k in group if k]


def pack(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(contents, number of sequences) that hold histogram[l] pieces of each length l exactly.

    The program decides on all lengths. Where it needs more sequences than the tokens do at least, it is asked again
    with short pieces left to fill in, at last with all; the plan of the fewest sequences counts, the first of equals."""
    histogram = histogram.astype(np.int64)
    bound = -(-int(histogram @ np.arange(len(histogram))) // capacity)
    best: list[tuple[dict[int, int], int]] = []
    fewest = None
    for part in LEAST:
        left = histogram.copy()
        plan = by_program(left, max(1, int(part * capacity)), capacity) if part <= 1 else []
        plan = fill(plan, left, capacity)
        n = sum(k for _, k in plan)
        if fewest is None or n < fewest:
            best, fewest = plan, n
        if fewest == bound:
            break
    return best


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces a sequence, offset), by first rank."""
    out: dict[int, list] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for contents, k in plan:
        offset = 0
        for length, each in sorted(contents.items(), reverse=True):
            out[length].append((ranks[length], sequence, each, offset))
            ranks[length] += each * k
            offset += each * length
        sequence += k
    return {k: np.array(v, np.int64) for k, v in out.items()}


def best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A document's ids end with the end id; only longer documents are cut. Null text: the end id alone. Null id and
    repeated rows: pieces of their own. Other columns are ignored.

    Pieces of one length are numbered by way of the stored table's partitions: counts of (partition, length) are
    summed up, so no length is gathered in one task. Lengths' places, a few thousand numbers however many pieces
    there are, go to all tasks."""
    stored = durable(pieces(docs, path, capacity, False, id_col, text_col).drop("tokens"))
    stored = stored.withColumn("part", F.spark_partition_id())
    counts = stored.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = durable(counts.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    totals = ahead.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in totals:
        histogram[r.length] = r.n
    where = places(pack(histogram, capacity))
    inside = Window.partitionBy("part", "length").orderBy("id", "piece", "ids_crc32")
    ranked = stored.join(ahead.select("part", "length", "ahead"), ["part", "length"]).withColumn("rank", F.col("ahead") + F.row_number().over(inside) - 1)
    out = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                rows = where[int(value)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                seat = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + seat // row[:, 2]
                offset[at] = row[:, 3] + seat % row[:, 2] * value
            yield c.rows(out, *[batch.column(k) for k in ("id", "piece", "start", "length", "ids_crc32")], sequence, offset)

    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(put, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.select(c.back_to_id().alias("doc_id"), *[x for x in out.names if x != "id"])
