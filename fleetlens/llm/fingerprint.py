"""Document fingerprints: all shingle hashes below a fixed fraction of the hash space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import common as c

FRACTION = 1 / 8
_PLACED = pa.schema([("block", pa.int32()), ("follows", pa.bool_()), ("id", pa.int64()), ("text", pa.string())])
_RESULT = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def sketches(texts: pa.Array, width: int = 5, fraction: float = FRACTION) -> list[np.ndarray]:
    """The sketch of each text: its distinct shingle hashes below `fraction` of the hash space, in order; the
    least hash is always in it, so only a text without words has an empty one."""
    data, offsets = c.buffers(texts)
    data = c.LOWER[data]
    starts, ends, doc = c.words(data, offsets)
    h, owner = c.shingles(c.word_hashes(data, starts, ends), doc, len(texts), width)
    least = np.full(len(texts), c.U(2**64 - 1))
    np.minimum.at(least, owner, h)
    keep = (h < c.U(int(fraction * 2**64))) | (h == least[owner])
    h, owner = c.distinct_pairs(h[keep], owner[keep])
    return np.split(h, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]) if len(texts) else []


def as_text(sketch: np.ndarray) -> str:
    """16 hexadecimal digits for each hash."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(c.U)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Sketch of two documents as one."""
    both = np.union1d(a, b)
    return both[(both < c.U(int(fraction * 2**64))) | (np.arange(len(both)) == 0)]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    k = _shared(a, b)
    union = len(a) + len(b) - k
    return k / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float | None:
    """Estimated share of a's shingles that b has, however much longer b is; 1 for an empty a.

    A sketch without hashes below `fraction` holds its least hash alone, which a longer document's sketch does
    not keep, so only hashes below it count. None where a has none there: it says nothing about b."""
    if not len(a):
        return 1.0
    bound = c.U(int(fraction * 2**64))
    low = a[a < bound]
    return _shared(low, b[b < bound]) / len(low) if len(low) else None


def _place(tops: np.ndarray):
    """Blocks of ids up to each of `tops`. The document at the top of a block also follows the block above it,
    and that at the top of all follows the lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            block = np.searchsorted(tops, ids)
            top = np.flatnonzero(tops[block] == ids)
            rows = np.concatenate((np.arange(len(ids)), top))
            blocks = np.concatenate((block, (block[top] + 1) % len(tops)))
            follows = np.arange(len(rows)) >= len(ids)
            yield c.rows(_PLACED, blocks, follows, ids[rows], batch.column("text").take(pa.array(rows)))

    return run


def _compare(width: int, fraction: float):
    def run(table: pa.Table) -> pa.Table:
        follows, ids = table.column("follows").to_numpy(), table.column("id").to_numpy()
        texts = table.column("text").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (bool(follows[i]), -int(ids[i]), texts[i]))
        n = int((~follows).sum())
        order = order[: n + 1]
        texts = [texts[i] for i in order]
        ids = ids[order[:n]]
        edited = []
        for text, after in zip(texts, texts[1:]):
            k = len(text) // 3
            edited.append(text[: len(text) - k] + after[:k])
        out = []
        start = 0
        while start < n:
            end, held = start, 0
            while end < n and (end == start or held + len(texts[end]) < c.STEP_BYTES // 2):
                held += len(texts[end])
                end += 1
            own = sketches(pa.array(texts[start : end + 1], pa.string()), width, fraction)
            new = sketches(pa.array(edited[start:end], pa.string()), width, fraction)
            out.append(c.rows(
                _RESULT, ids[start:end], [len(t) for t in texts[start:end]], edited[start:end],
                [as_text(s) for s in own[:-1]], [as_text(s) for s in new],
                [jaccard(a, b) for a, b in zip(own, new)], [jaccard(a, b) for a, b in zip(own, own[1:])],
            ))
            start = end
        return pa.Table.from_batches(out, _RESULT)

    return run


def compare_neighbours(docs: DataFrame, width: int = 5, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited text, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The next document is the one before it in the order of ids, after the first the last; equal ids are in the
    order of their texts. The edited text has the last third of the code points replaced by the first as many,
    or all, of the next document. Sets are of `width`-word shingles in lower case for A-Z; with fewer words,
    all words are one shingle.

    Documents meet their neighbours in blocks of ids with about equal numbers, so texts are shuffled once. Only
    the ids at the tops of the blocks come to the driver. Null text: empty. Null id: behind all ids. Other
    columns are ignored."""
    spark = docs.sparkSession
    c.bounded_batches(spark)
    texts = c.texts_of(docs, id_col, text_col)
    n = c.block_count(texts, 16 << 20)
    shares = F.array(*[F.lit((k + 1) / n) for k in range(n - 1)]) if n > 1 else F.array(F.lit(1.0))
    row = texts.agg(F.percentile_approx("id", shares, max(10_000, 20 * n)).alias("tops"), F.max("id").alias("top")).first()
    tops = np.unique(np.array([*(row.tops or []), row.top if row.top is not None else c.LAST_ID], np.int64))
    placed = texts.mapInArrow(_place(tops), "block int, follows boolean, id long, text string")
    schema = "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = placed.groupBy("block").applyInArrow(_compare(width, fraction), schema)
    return found.select(c.back_to_id().alias("doc_id"), *[x for x in _RESULT.names if x != "id"])
