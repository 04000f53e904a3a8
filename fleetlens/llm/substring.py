"""Substring deduplication with Rabin-Karp hashes of every fixed-length word window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import common as c
from fleetlens.session import durable

_PARCEL = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("blob", pa.binary())])
_NOTE = pa.schema([("key", pa.int32()), ("blob", pa.binary())])
_RESULT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.string())])
WINDOWS, NOTES = 0, 1


def _windows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window hash, document of the window, first word of the window, first word of each document)."""
    data, offsets = c.buffers(batch.column("text"))
    starts, ends, doc = c.words(data, offsets)
    whole = c.rolling(c.word_hashes(data, starts, ends), width)
    at = np.flatnonzero(doc[: len(whole)] == doc[width - 1 :]) if len(whole) else np.zeros(0, np.int64)
    return whole[at], doc[at], at, np.searchsorted(doc, np.arange(batch.num_rows + 1))


def _split(h: np.ndarray, ids: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of the distinct (hash, id), those with the smallest id of their hash, and the others."""
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    if len(h):
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])))
        h, ids = h[keep], ids[keep]
    least = np.zeros(len(h), bool)
    least[c.starts_of(h)] = True
    return (h[least], ids[least]), (h[~least], ids[~least])


def _by_document(h: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Parcels of (hash, id) by key: each id once, with the number of its hashes."""
    order = np.lexsort((ids, keys))
    h, ids, keys = h[order], ids[order], keys[order]
    for key, part in c.cut_by(keys):
        first = c.starts_of(ids[part])
        counts = np.diff(np.append(first, part.stop - part.start)).astype(np.uint32)
        yield key, c.pack(ids[part][first], counts, h[part])


def _open(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    parts = [c.unpack(b.as_buffer(), np.int64, np.uint32, np.uint64) for b in blobs]
    if not parts:
        return np.zeros(0, c.U), np.zeros(0, np.int64)
    return np.concatenate([p[2] for p in parts]), np.concatenate([np.repeat(p[0], p[1]) for p in parts])


def _parcels(width: int, slices: int, k: int, buckets: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.steps(batches):
            ids = batch.column("id").to_numpy()
            h, doc, _, _ = _windows(batch, width)
            mine = h % c.U(slices) == k
            (h0, i0), (h1, i1) = _split(h[mine], ids[doc[mine]])
            out = [(WINDOWS, *x) for x in _by_document(h0, i0, c.bucket_of(h0, buckets).astype(np.int64))]
            out += [(NOTES, *x) for x in _by_document(h1, i1, c.doc_block(i1, blocks))]
            if out:
                yield c.rows(_PARCEL, *zip(*out))

    return run


def _matches(blocks: int):
    def run(key: tuple, parcels: pa.Table) -> pa.Table:
        if key[0].as_py() == NOTES:
            return parcels.select(["key", "blob"])
        _, (h, ids) = _split(*_open(parcels.column("blob")))
        out = list(_by_document(h, ids, c.doc_block(ids, blocks)))
        return pa.Table.from_batches([c.rows(_NOTE, *zip(*out))] if out else [], _NOTE)

    return run


def _apply(width: int):
    def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
        h, ids = _open(notes.column("blob"))
        order = np.lexsort((h, ids))
        h, ids = h[order], ids[order]
        out = []
        for batch in c.steps(texts.to_batches()):
            own = batch.column("id").to_numpy()
            windows, doc, at, first = _windows(batch, width)
            lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            span = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            texts_ = [t.as_buffer().to_pybytes() for t in batch.column("text").cast(pa.binary())]
            cols: list = [[], [], [], []]
            kept = []
            for d in range(batch.num_rows):
                words = texts_[d].split()
                mine = slice(span[d], span[d + 1])
                hit = at[mine][np.isin(windows[mine], h[lo[d] : hi[d]])] - first[d] if hi[d] > lo[d] else at[:0]
                s, e = c.merged(hit, hit + width)
                for a, b in zip(s[::-1].tolist(), e[::-1].tolist()):
                    del words[a:b]
                for col, v in zip(cols, (int(first[d + 1] - first[d]), int((e - s).sum()), s, e)):
                    col.append(v)
                kept.append(b" ".join(words))
            out.append(c.rows(_RESULT, own, *cols, pa.array(kept, pa.binary()).cast(pa.string())))
        return pa.Table.from_batches(out, _RESULT)

    return run


def remove_repeats(docs: DataFrame, width: int = 13, slices: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, intervals and kept text of every document.

    A word goes if a window of `width` words covers it whose words also start in a document with a smaller id.
    All windows are judged on the input. `intervals` are the maximal runs of removed words, [start, end) in
    words; `kept` has the other words joined by one space.

    Tasks hash every window and keep the smallest id of each hash they see; other documents with it are known
    to lose it and are noted at once, so a window that very many documents share leaves a task once. The hash
    space is worked off in `slices` passes, so that one pass's shuffle is a fraction of the text. A document
    gets the hashes it loses back, and finds their places when its text is read again.

    Null text: no words. Null id: behind all ids; such documents, like rows that repeat an id, do not remove
    each other's words. Rows stay as many as they were. Other columns are ignored."""
    spark = docs.sparkSession
    c.bounded_batches(spark)
    texts = c.texts_of(docs, id_col, text_col)
    buckets, blocks = c.block_count(texts, 16 << 20), c.odd(c.block_count(texts, 16 << 20))
    notes = None
    for k in range(slices):
        parcels = texts.mapInArrow(_parcels(width, slices, k, buckets, blocks), "kind int, key int, blob binary")
        part = durable(parcels.groupBy("kind", "key").applyInArrow(_matches(blocks), "key int, blob binary"))
        notes = part if notes is None else notes.unionByName(part)
        del parcels
        c.release(spark)
    left = texts.withColumn("key", c.doc_block(F.col("id"), blocks))
    schema = "id long, n_words long, n_removed long, starts array<long>, ends array<long>, kept string"
    found = left.groupBy("key").cogroup(notes.groupBy("key")).applyInArrow(_apply(width), schema)
    intervals = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    return found.select(c.back_to_id().alias("doc_id"), "n_words", "n_removed", intervals.alias("intervals"), "kept")
