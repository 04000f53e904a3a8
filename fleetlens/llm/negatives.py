"""Hard-negative mining: exact integer scores from float32 products modulo small primes, then windows of scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm import common as c
from fleetlens.session import durable

#: Dimensions of one float32 product. Centred residues of primes below 1024 add up to less than 2^24 over them.
WIDTH = 64
#: Largest squared length that a row may have, so that every score fits a long.
MAX_SQUARES = 1 << 62
#: Rows of a packed block, anchors of a block of anchors, rows and anchors of one tile of scores, rows of one task.
BLOCK_ROWS, ANCHORS, TILE, TASK_ROWS = 4096, 32_768, 2048, 4_000_000
NONE = np.iinfo(np.int64).min


def _primes(below: int, count: int) -> list[int]:
    return [n for n in range(below - 1, 2, -1) if all(n % d for d in range(2, isqrt(n) + 1))][:count]


#: Their product exceeds twice the largest score.
PRIMES = _primes(1024, 7)


def residues(v: np.ndarray, p: int) -> np.ndarray:
    """Centred residues modulo the odd prime `p`, as float32."""
    half = p // 2
    return (np.mod(v + half, p) - half).astype(np.float32)


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole float32 values below 2^24, at most one beyond p/2 in size."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exactly.

    The matrices are multiplied modulo as many primes as four times the largest possible score needs (a score is at
    most the product of the largest lengths). Centred mixed-radix digits then give the signed scores: every
    digit is found modulo its prime from the residue less what the digits before it stand for."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    longest = lambda m: isqrt(int(np.einsum("ij,ij->i", m, m).max(initial=0))) + 1
    bound, digits, radix = 4 * longest(a) * longest(b), [], 1
    out = np.zeros((len(a), len(b)), np.int64)
    for p in PRIMES:
        left, right = residues(a, p), residues(b, p).T
        digit = np.zeros(out.shape, np.float32)
        for at in range(0, width, WIDTH):
            digit += _centred(left[:, at : at + WIDTH] @ right[at : at + WIDTH], p)
            digit = _centred(digit, p)
        weight = 1
        for q, d in zip(PRIMES, digits):
            digit = _centred(digit - d * np.float32(weight), p)
            weight = weight * q % p
        digit = _centred(digit * np.float32(pow(radix, -1, p)), p)
        out += digit.astype(np.int64) * np.uint64(radix % (1 << 64)).astype(np.int64)
        digits.append(digit)
        radix *= p
        if radix > bound:
            break
    return out


def _pack_rows(ids, labels, vectors: np.ndarray) -> tuple[int, int, bytes]:
    """(rows, dimensions, bytes); components take as few bytes as the largest needs."""
    most = int(np.abs(vectors).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return len(ids), vectors.shape[1], c.pack(ids, labels, vectors.astype(kind).ravel(), np.array([np.dtype(kind).itemsize], np.uint8))


def _unpack_rows(n: int, width: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[blob[-1]]
    ids, labels, v, _ = c.unpack(blob, np.int64, np.int64, kind, np.uint8)
    return ids, labels, v.reshape(n, width).astype(np.int64)


_BLOCK = pa.schema([("n", pa.int32()), ("width", pa.int32()), ("blob", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks of up to BLOCK_ROWS rows, each in order of id. A short vector ends in zeros."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            ids, labels = (part.column(name).to_numpy(zero_copy_only=False) for name in ("id", "label"))
            lists = part.column("vector")
            counts = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            v = np.zeros((len(ids), int(counts.max(initial=0))), np.int64)
            v[np.repeat(np.arange(len(ids)), counts), np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
            order = np.argsort(ids, kind="stable")
            n, width, blob = _pack_rows(ids[order], labels[order], v[order])
            yield c.rows(_BLOCK, [n], [width], [blob])


_ANCHOR = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("width", pa.int32()), ("blob", pa.binary())])


def _anchors_of(every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, width, blob in zip(*(batch.column(name).to_pylist() for name in ("block", "n", "width", "blob"))):
                ids, labels, v = _unpack_rows(n, width, blob)
                at = np.flatnonzero((ids % every == 0) & (ids != c.LAST_ID))
                uids = block * BLOCK_ROWS + at
                blobs = [_pack_rows(ids[i : i + 1], labels[i : i + 1], v[i : i + 1])[2] for i in at]
                yield c.rows(_ANCHOR, uids, ids[at], np.full(len(at), width, np.int32), blobs)

    return run


class Best:
    """The best `k` (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.score = np.full((slots, k), NONE, np.int64)
        self.id = np.full((slots, k), c.LAST_ID, np.int64)
        self.k = k

    def offer(self, slots: np.ndarray, found: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores `found` of rows `ids`, in order of id, for the given slots; those not `allowed` do not count."""
        last_score, last_id = self.score[slots, -1:], self.id[slots, -1:]
        better = allowed & ((found > last_score) | ((found == last_score) & (ids[None, :] < last_id)))
        some = np.flatnonzero(better.any(axis=1))
        if not len(some):
            return
        rest = np.where(better[some], found[some], NONE)
        line = np.arange(len(some))
        new_score, new_id = np.empty((len(some), self.k), np.int64), np.empty((len(some), self.k), np.int64)
        for j in range(self.k):
            at = rest.argmax(axis=1)  # the first of equal ones: the smallest id
            new_score[:, j] = rest[line, at]
            new_id[:, j] = np.where(new_score[:, j] == NONE, c.LAST_ID, ids[at])
            rest[line, at] = NONE
        s = slots[some]
        both = np.concatenate((self.score[s], new_score), axis=1), np.concatenate((self.id[s], new_id), axis=1)
        order = np.lexsort((both[1], ~both[0]), axis=1)[:, : self.k]
        self.score[s], self.id[s] = (np.take_along_axis(m, order, axis=1) for m in both)


_FOUND = pa.schema([("uid", pa.int64()), ("anchor", pa.int64()), ("slot", pa.int32()), ("found", pa.int64()), ("score", pa.int64())])


def _mine(k: int, bands: int, positives: bool, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a task: a block of anchors, then packed blocks of rows one after another; then the next block of anchors.

    For the positives there is one slot an anchor and rows of its label count, but for itself. For the negatives there is a
    slot for each positive, and rows of other labels count whose score lies in the slot's window."""

    def flush(held) -> Iterator[pa.RecordBatch]:
        if held:
            uid, best = held["uid"], held["best"]
            row, col = np.nonzero(best.score != NONE)
            for at in range(0, len(row), 1 << 16):
                r, j = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
                yield c.rows(_FOUND, uid[r // bands], held["id"][r // bands], (r % bands).astype(np.int32), best.id[r, j], best.score[r, j])

    def load(anchors: list[dict]) -> dict:
        width = max(a["width"] for a in anchors)
        v = np.zeros((len(anchors), width), np.int64)
        label = np.empty(len(anchors), np.int64)
        uid, ids = (np.array([a[name] for a in anchors], np.int64) for name in ("uid", "id"))
        top = np.full((len(anchors), bands), NONE, np.int64)
        for i, a in enumerate(anchors):
            _, (label[i],), row = _unpack_rows(1, a["width"], a["blob"])
            v[i, : a["width"]] = row[0]
            if not positives:
                top[i, : len(a["tops"])] = a["tops"]
        return {"uid": uid, "id": ids, "label": label, "v": v, "top": top, "best": Best(len(anchors) * bands, k)}

    def tile(held, block: int, ids, labels, v, a: slice, b: slice) -> None:
        found = scores(held["v"][a], v[b])
        same = held["label"][a][:, None] == labels[b][None, :]
        rows = np.arange(a.start, min(a.stop, len(held["uid"])))
        if positives:
            other = held["uid"][a][:, None] != (block * BLOCK_ROWS + np.arange(b.start, min(b.stop, len(ids))))[None, :]
            held["best"].offer(rows, found, ids[b], same & other)
            return
        different = ~same
        for j in range(bands):
            top = held["top"][a][:, j : j + 1]
            # low * top <= 100 * score <= high * top, without a product beyond a long
            least, most = top // 100 * low - (-low * (top % 100)) // 100, top // 100 * high + high * (top % 100) // 100
            held["best"].offer(rows * bands + j, found, ids[b], different & (top != NONE) & (found >= least) & (found <= most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["anchors"] is not None:
                    yield from flush(held)
                    held = load(row["anchors"])
                    continue
                if held is None:
                    continue
                ids, labels, v = _unpack_rows(row["n"], row["width"], row["blob"])
                for a in range(0, len(held["uid"]), TILE):
                    for b in range(0, len(ids), TILE):
                        tile(held, row["block"], ids, labels, v, slice(a, a + TILE), slice(b, b + TILE))
        yield from flush(held)

    return run


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column, scale: int) -> Column:
    """Whether all components are finite numbers and the quantised row is no longer than a score allows."""
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"), F.lit(2.0)))
    return F.coalesce(vector.isNotNull() & numbers, F.lit(False)) & (squares < float(MAX_SQUARES))


def hard_negatives(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), one row per hard negative.

    Anchors are the rows whose id is divisible by `every`. A score is the inner product of two rows of integers
    floor(scale * x); higher scores come first, then smaller ids. The positives of an anchor are its first `positives` other
    rows of its label. For each of them, the first `negatives` rows of another label count whose score is between `low` and
    `high` percent of the positive's; ranks begin at 1.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows whose
    quantised vector is 2^31 long or longer: their scores would not fit a long. A null id is no anchor and comes last.
    Of vectors of unequal length the shorter one ends in zeros. Rows that share an id are rows of their own, so that
    an anchor id that occurs twice has all its results twice.

    Every anchor meets every row: blocks of anchors stay in a task while packed blocks of rows stream by. A task holds
    one of each and the best rows so far; it returns a few rows per anchor, which windows then merge."""
    spark = rows.sparkSession
    c.bounded_batches(spark)
    vector = F.col(vector_col)
    plain = rows.where(F.col(label_col).isNotNull() & usable(vector, scale)).select(c.id_column(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), quantised(vector, scale).alias("vector"))
    packed = plain.mapInArrow(_blocks, "n int, width int, blob binary")
    packed = durable(packed.select(F.monotonically_increasing_id().alias("block"), "n", "width", "blob"))
    # A block's number times BLOCK_ROWS must fit a long: partition in the upper bits, block in the lower 20.
    number = F.shiftleft(F.shiftright("block", 33), 20).bitwiseOR(F.col("block").bitwiseAND(F.lit((1 << 20) - 1)))
    packed = packed.withColumn("block", number)
    anchors = packed.mapInArrow(_anchors_of(every), "uid long, id long, width int, blob binary")
    n_rows, n_anchors = packed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n, anchors.count()
    parts = max(1, -(-n_anchors // ANCHORS))
    shares = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts), -(-n_rows // TASK_ROWS))

    def search(anchors: DataFrame, mine) -> DataFrame:
        """(uid, slot, found, score) from every share of the rows."""
        extra = [f for f in anchors.columns if f == "tops"]
        held = anchors.groupBy(F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("uid", "id", "width", "blob", *extra)).alias("anchors"))
        place = lambda share: (F.col("part") * shares + share).cast("int")
        left = held.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(place(F.col("share")).alias("place"), F.lit(-1).cast("long").alias("block"), F.lit(0).alias("n"), F.lit(0).alias("width"), F.lit(b"").alias("blob"), "anchors")
        right = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
            place(F.pmod(F.xxhash64("block"), F.lit(shares))).alias("place"), "block", "n", "width", "blob", F.lit(None).cast(left.schema["anchors"].dataType).alias("anchors")
        )
        tasks = left.unionByName(right).repartitionById(parts * shares, "place").sortWithinPartitions("place", "block")
        return tasks.mapInArrow(mine, "uid long, anchor long, slot int, found long, score long")

    ranked = W.partitionBy("uid", "slot").orderBy(F.desc("score"), "found")
    first = lambda df, k: df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    chosen = durable(first(search(anchors, _mine(positives, 1, True, low, high)), positives))
    tops = chosen.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("tops"))
    found = first(search(anchors.join(tops, "uid"), _mine(negatives, positives, False, low, high)), negatives)
    pairs = chosen.select("uid", (F.col("rank") - 1).alias("slot"), F.col("found").alias("positive"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["uid", "slot"]).select(
        F.col("anchor").alias("anchor_id"), c.back_to_id("positive").alias("positive_id"), "rank",
        c.back_to_id("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
