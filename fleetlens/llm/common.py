"""Helpers shared by the operators: words and hashes of whole Arrow columns, packed rows, blocks."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A null identifier sorts behind all others.
LAST_ID = 2**63 - 1
#: Bytes of text that one numpy step works on; temporaries take about 60 times as much.
STEP_BYTES = 3 << 20
BATCH_BYTES = 8 << 20

U = np.uint64
_RNG = np.random.default_rng(20240607)
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
#: Random numbers for the bytes of the first places of a word; those of later places are mixed when they occur.
PLACES = 64
PLACE_HASH = _RNG.integers(0, 2**64, PLACES * 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_count(df: DataFrame, block_bytes: int) -> int:
    """How many blocks of about `block_bytes` hold `df`, by Spark's own size statistics; at least the
    session's shuffle partitions. A larger estimate only makes smaller blocks."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size // block_bytes), 1 << 17))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps; it does so when its references are collected. Twice, since
    events of the last job may still be on their way and hold them."""
    for wait in (0.3, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def id_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): a null id as LAST_ID, a null text as the empty text."""
    return docs.select(*text_columns(id_col, text_col))


def text_columns(id_col: str, text_col: str) -> tuple[Column, Column]:
    return id_column(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")


def id_block(n: int, col: str = "id") -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = U(1)
        np.multiply.accumulate(out, out=out)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(29)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word of the texts that lie end to end in `data`."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: the sum of a random number for each byte at its place. Unlike sums of powers
    of a base, these have no two words that clash by construction."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    byte = data[np.repeat(starts, lengths) + place]
    late = np.flatnonzero(place >= PLACES)
    if len(late):
        terms = PLACE_HASH[np.minimum(place, PLACES - 1) * 256 + byte]
        terms[late] = mix(BYTE_HASH[byte[late]] ^ mix(place[late].astype(U) * BASE))
    else:
        terms = PLACE_HASH[place * 256 + byte]
    return mix(np.add.reduceat(terms, first))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every `width` consecutive values, from one running sum."""
    n = len(values)
    if n < width:
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(values * powers(n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(n - width + 1, BASE_INVERSE))


def shingles(word_hash: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each shingle of `width` words; a shorter document's words make one shingle.
    Grouped by document, in no given order inside it, repeats kept."""
    counts = np.bincount(doc, minlength=n_docs)
    whole = rolling(word_hash, width)
    ok = doc[: len(whole)] == doc[width - 1 :] if len(whole) else np.zeros(0, bool)
    hashes, owners = [whole[ok]], [doc[: len(whole)][ok]]
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    for k in range(1, width):
        short = np.flatnonzero(counts == k)
        if len(short):
            sums = sum(word_hash[first[short] + i] * powers(width)[i] for i in range(k))
            hashes.append(mix(mix(sums) + U(k)))
            owners.append(short)
    return np.concatenate(hashes), np.concatenate(owners)


def distinct_pairs(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (owner, hash) once, in the order of owners, then hashes."""
    if not len(hashes):
        return hashes, owners
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owners[order], kind="stable")]
    h, o = hashes[order], owners[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], o[keep]


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0..n-1 in the order of the hashes."""
    return ((hashes >> U(32)) * U(n)) >> U(32)


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.uint32).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    counts = np.frombuffer(blob, np.uint32, len(kinds))
    out, at = [], 4 * len(kinds)
    for n, kind in zip(counts, kinds):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new group begins, in arrays sorted by these keys."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of half-open ones; those that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    first = np.flatnonzero(new)
    return s[first], np.append(e[first[1:] - 1], e[-1])


def doc_block(ids, n: int):
    """Block 0..n-1 of document ids, alike for a column and for a numpy array. `n` is odd, see `odd`."""
    if isinstance(ids, np.ndarray):
        return (ids ^ (ids >> 15) ^ (ids >> 31)) % n
    return F.pmod(ids.bitwiseXOR(F.shiftright(ids, 15)).bitwiseXOR(F.shiftright(ids, 31)), F.lit(n)).cast("int")


def odd(n: int) -> int:
    return n | 1


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def cut_by(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, slice) of each run of equal keys."""
    first = starts_of(keys)
    for a, b in zip(first, np.append(first[1:], len(keys))):
        yield int(keys[a]), slice(int(a), int(b))


def back_to_id(col: str = "id"):
    """The identifier as it was given: LAST_ID stood for null."""
    return F.when(F.col(col) != LAST_ID, F.col(col))
