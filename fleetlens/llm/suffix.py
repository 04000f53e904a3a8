"""Suffix-array deduplication: repeated byte strings, found in collections whose Burrows-Wheeler transform and
common prefixes are built one column at a time.

Two equal strings of `length` bytes have the same anchor at the same place: the gram with the smallest hash. Each
run of windows with one anchor is a segment. Equal segments are settled by their hash. Different segments of one anchor
share a window only if they have the same bytes on one side of it, its context; those that do meet in a collection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import common as c
from fleetlens.session import durable

GRAM = 16
BLOCK = 64
#: Bytes of text that are cut into segments at a time; temporaries take about 120 times as much.
STEP_BYTES = 1 << 19
#: Bytes of text whose segments are settled and packed together.
PARCEL_BYTES = 4 << 20
#: Bytes of segments that one collection sorts.
COLLECTION_BYTES = 1 << 19
#: Bytes of a block of documents, and of the text whose segments meet in one task, as Spark estimates them.
BLOCK_BYTES = 2 << 20
#: The different segments of one anchor meet in one collection up to this number; beyond it, window by window.
SEGMENTS_OF_ANCHOR = 2048
#: Windows of anchors taken apart that meet in one task.
BUCKET_WINDOWS = 1 << 18
#: With the hash of `common`, a second one of other numbers: windows of anchors taken apart are told apart by 128 bits.
SECOND_HASH, SECOND_BASE = c.mix(c.BYTE_HASH), c.U(0xD1342543DE82EF95)
SECOND_INVERSE = c.U(pow(int(SECOND_BASE), -1, 2**64))
_PARCEL = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("blob", pa.binary())])
#: Of the blob: ids, their counts, and of each place its first byte, its size and, if it is to be compared, its anchor.
_HIT = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("size", pa.int64()), ("blob", pa.binary())])
_SEGMENT = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("id", pa.int64()), ("start", pa.int64()), ("blob", pa.binary())])
_PLACE = (np.uint32, np.uint32)
_SEGMENT_KINDS = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8)
_WINDOW_KINDS = (np.uint64, np.uint64, np.uint32)
_RESULT = ("id", "n_bytes", "n_removed", "starts", "ends", "kept")
SEGMENTS, REMOVED, COMPARE, SPREAD = 0, 1, 2, 3


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive keys, by doubling."""
    least, size = keys, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(least) - (width - size)], least[width - size :]) if size < width else least


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, document, first byte in the document, hash of the left context, of the right one,
    number of windows, bytes before the anchor) of each segment.

    A window that begins `half` bytes or more before its anchor holds the left context, those bytes and the anchor; any
    other holds the right one, the anchor and what is behind it. A context that no window of the segment holds is 0."""
    n = len(data)
    if n < length:
        return (np.zeros(0, c.U),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint32),) * 2 + (np.zeros(0, np.int64),) * 2
    sums = np.zeros(n + 1, c.U)
    np.cumsum(c.BYTE_HASH[data] * c.powers(n), out=sums[1:])
    inverse = c.powers(n, c.BASE_INVERSE)
    grams = c.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    keys = grams & c.U(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=c.U)
    anchor = (_sliding_least(keys, length - GRAM + 1) & c.U(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(len(anchor) + 1, np.int8)
    last = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    np.add.at(ok, np.minimum(offsets[:-1], len(anchor)), 1)
    np.add.at(ok, np.minimum(last, len(anchor)), -1)
    at = np.flatnonzero(np.cumsum(ok[:-1]))
    doc = np.searchsorted(offsets, at, "right") - 1
    first = c.starts_of(anchor[at], doc)
    begin, stop = at[first], (at[np.append(first[1:], len(at)) - 1] + 1 if len(at) else at)
    whole = c.mix((sums[stop + length - 1] - sums[begin]) * inverse[begin] + (stop - begin).astype(c.U))
    anchor, doc, half = anchor[begin], doc[first], _half(length)

    def context(has: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(has), np.uint32)
        start, end = start[has], end[has]
        out[has] = np.maximum((c.mix((sums[end] - sums[start]) * inverse[start]) >> c.U(32)).astype(np.uint32), 1)
        return out

    left = context(anchor - begin >= half, anchor - half, anchor + GRAM)
    right = context(anchor - stop + 1 < half, anchor, anchor + length - half + 1)
    return grams[anchor], whole, doc, begin - offsets[doc], left, right, stop - begin, anchor - begin


def _half(length: int) -> int:
    return (length - GRAM) // 2 + 1


def _first_of_each(anchor, whole, ids, starts, *more):
    """Segments with the least (id, start) of their (anchor, segment) hashes, in that order; the later ones."""
    order = np.lexsort((starts, ids, whole, anchor))
    cols = [x[order] for x in (anchor, whole, ids, starts, *more)]
    group = c.starts_of(cols[0], cols[1])
    rank = np.repeat(group, np.diff(np.append(group, len(order))))
    first = np.zeros(len(order), bool)
    first[group] = True
    later = ~first & ((cols[2] != cols[2][rank]) | (cols[3] != cols[3][rank]))
    return [x[first] for x in cols], [x[later] for x in cols]


def _packed(keys: np.ndarray, ids: np.ndarray, *cols: np.ndarray) -> Iterator[tuple[int, slice, bytes]]:
    """(key, slice, blob) of each run of equal keys, of rows sorted by key and id."""
    for key, part in c.cut_by(keys):
        i = ids[part]
        begins = c.starts_of(i)
        yield key, part, c.pack(i[begins], np.diff(np.append(begins, len(i))).astype(np.uint32), *(x[part] for x in cols))


def _open(blobs: pa.ChunkedArray, *kinds) -> list[np.ndarray]:
    """The ids and other columns of packed rows, small numbers as long ones."""
    parts = [c.unpack(b.as_buffer(), np.int64, np.uint32, *kinds) for b in blobs]
    if not parts:
        return [np.zeros(0, np.int64), *(np.zeros(0, k if k == np.uint64 else np.int64) for k in kinds)]
    ids = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
    return [ids, *(np.concatenate([p[k + 2] for p in parts]).astype(kind if kind == np.uint64 else np.int64, copy=False) for k, kind in enumerate(kinds))]


def _by_block(kind: int, blocks: int, length: int, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """Rows of `_HIT`, one for each block of documents. Size: bytes to remove or to compare, or windows."""
    keys = c.doc_block(ids, blocks)
    order = np.lexsort((starts, ids, keys))
    keys, ids, starts, sizes, *more = (x[order] for x in (keys, ids, starts, sizes, *more))
    for key, part, blob in _packed(keys, ids, starts.astype(np.uint32), sizes.astype(np.uint32), *more):
        yield kind, key, int(sizes[part].sum()) + (part.stop - part.start) * (length if kind == COMPARE else 0), blob


def _removed(blocks: int, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
    """Rows of `_HIT` that remove these intervals."""
    order = np.lexsort((starts, ids))
    ids, starts, ends = _joined(ids[order], starts[order], ends[order])
    return _by_block(REMOVED, blocks, 0, ids, starts, ends - starts)


def _table(schema: pa.Schema, out: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([c.rows(schema, *zip(*out))] if out else [], schema)


def _parcels(length: int, buckets: int, blocks: int):
    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        first, (_, _, i, s, _, _, n, _) = _first_of_each(*map(np.concatenate, zip(*held)))
        out = [(kind, key, blob) for kind, key, _, blob in _removed(blocks, i, s, s + n + length - 1)]
        keys = c.bucket_of(c.mix(first[0]), buckets).astype(np.int64)
        order = np.lexsort((first[2], keys))
        anchor, whole, i, s, left, right, n, before = (x[order] for x in first)
        out += [(SEGMENTS, key, blob) for key, _, blob in _packed(keys[order], i, anchor, whole, left, right, s.astype(np.uint32), n.astype(np.uint8), before.astype(np.uint8))]
        if out:
            yield c.rows(_PARCEL, *zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in c.steps(batches, most=STEP_BYTES):
            data, offsets = c.buffers(batch.column("text").cast(pa.binary()))
            anchor, whole, doc, *more = segments_of(data, offsets, length)
            held.append((anchor, whole, batch.column("id").to_numpy()[doc], *more))
            size += len(data)
            if size >= PARCEL_BYTES:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    return run


def _again(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Whether another segment of the anchor has the same context."""
    order = np.lexsort((context, anchor))
    group = c.starts_of(anchor[order], context[order])
    times = np.diff(np.append(group, len(order)))
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(times, times) > 1
    return out & (context != 0)


def _hits(length: int, blocks: int):
    """Of equal segments the later ones are removed. Of the different segments of an anchor those are asked for that have
    a context in common, without the windows that do not hold it."""

    def run(key: tuple, parcels: pa.Table) -> pa.Table:
        if key[0].as_py() == REMOVED:
            i, s, n = _open(parcels.column("blob"), *_PLACE)
            return _table(_HIT, [*_removed(blocks, i, s, s + n)])
        ids, anchor, whole, left, right, starts, sizes, before = _open(parcels.column("blob"), *_SEGMENT_KINDS)
        first, (_, _, i, s, _, _, n, _) = _first_of_each(anchor, whole, ids, starts, left, right, sizes, before)
        out = [*_removed(blocks, i, s, s + n + length - 1)]
        anchor, _, ids, starts, left, right, sizes, before = first
        left, right = _again(anchor, left), _again(anchor, right)
        cut = np.clip(before - _half(length) + 1, 0, sizes)  # so many windows hold the left context, the others the right one
        begin, end = np.where(left, 0, cut), np.where(right, sizes, cut)
        keep = left | right
        anchor, ids, starts, sizes = anchor[keep], ids[keep], (starts + begin)[keep], (end - begin)[keep]
        counts = np.diff(np.append(c.starts_of(anchor), len(anchor)))
        many = np.repeat(counts, counts) > SEGMENTS_OF_ANCHOR
        for kind, at in ((COMPARE, ~many), (SPREAD, many)):
            out += _by_block(kind, blocks, length, ids[at], starts[at], sizes[at], anchor[at])
        return _table(_HIT, out)

    return run


def _window_hashes(data: np.ndarray, offsets: np.ndarray, length: int, *numbers) -> tuple[np.ndarray, ...]:
    """(string, first byte) of each window, and its hashes by each (numbers of the bytes, base, inverse of the base)."""
    n = len(data)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(owner)) + np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    out = []
    for numbers_, base, inverse in numbers:
        sums = np.zeros(n + 1, c.U)
        np.cumsum(numbers_[data] * c.powers(n, base), out=sums[1:])
        out.append((sums[at + length] - sums[at]) * c.powers(n, inverse)[at])
    return owner, at, *out


_FIRST = (c.BYTE_HASH, c.BASE, c.BASE_INVERSE)


def _spread_windows(length: int, buckets: int, blocks: int, texts: list[bytes], ids: list[int], starts: list[int]) -> Iterator[tuple]:
    """Rows of `_SEGMENT` for segments that are cut into their windows: of equal windows only the earliest goes on, as a
    segment of its own, and the others are removed."""
    offsets = np.cumsum([0, *map(len, texts)])
    owner, at, a, b = _window_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets, length, _FIRST, (SECOND_HASH, SECOND_BASE, SECOND_INVERSE))
    (a, b, i, s), (_, _, gone, s_gone) = _first_of_each(c.mix(a), b, np.array(ids, np.int64)[owner], np.array(starts, np.int64)[owner] + at - offsets[owner])
    yield from ((kind, key, 0, 0, blob) for kind, key, _, blob in _removed(blocks, gone, s_gone, s_gone + length))
    keys = c.bucket_of(a, buckets).astype(np.int64)
    order = np.lexsort((i, keys))
    yield from ((SPREAD, key, 0, 0, blob) for key, _, blob in _packed(keys[order], i[order], a[order], b[order], s[order].astype(np.uint32)))


def _cut_out(length: int, buckets: int, spread: int, blocks: int):
    """The bytes of the segments to compare, and the windows of those to spread."""

    def places(texts: pa.Table, asked: pa.Table, kind: int) -> Iterator[tuple[int, int, bytes, int]]:
        blobs = asked.column("blob").filter(np.equal(asked.column("kind").to_numpy(), kind))
        ids, starts, sizes, anchor = _open(blobs, *_PLACE, np.uint64)
        order = np.argsort(ids, kind="stable")
        ids, starts, sizes, anchor = ids[order], starts[order], sizes[order], anchor[order]
        own = texts.column("id").to_numpy()
        lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        keys = c.bucket_of(c.mix(anchor), buckets)  # anchors are small hashes
        for d in np.flatnonzero(hi > lo).tolist():
            text = texts.column("text")[d].as_buffer().to_pybytes()
            for k in range(lo[d], hi[d]):
                a = int(starts[k])
                yield int(own[d]), a, text[a : a + int(sizes[k]) + length - 1], int(keys[k])

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(COMPARE, key, i, a, text) for i, a, text, key in places(texts, asked, COMPARE)]
        some, held = [], 0
        for i, a, text, _ in places(texts, asked, SPREAD):
            some.append((text, i, a))
            held += len(text)
            if held >= STEP_BYTES:
                out += _spread_windows(length, spread, blocks, *zip(*some))
                some, held = [], 0
        if some:
            out += _spread_windows(length, spread, blocks, *zip(*some))
        return _table(_SEGMENT, out)

    return run


def sorted_suffixes(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the suffix before) of all suffixes of the strings in sorted order.

    The transform holds, for each sorted suffix, the symbol before it. Round j puts the suffix of length j of every
    string in its place: behind as many suffixes with its first symbol as the transform has of that symbol before
    the place of its own tail. A new suffix's common prefix with a neighbour is one more than the least one between
    their tails. Prefixes count up to `most`. At the end the transform is walked once to name the suffixes."""
    m, ends, sizes = len(offsets) - 1, offsets[1:], np.diff(offsets)
    before = lambda s, n: np.where(n < sizes[s], data[np.maximum(ends[s] - 1 - n, 0)].astype(np.int16) + 1, 0).astype(np.uint8)
    owner = np.arange(m)
    place = np.arange(m)  # of the suffixes put in last
    bwt = before(owner, 0) if m else np.zeros(0, np.uint8)
    common = np.zeros(m, np.uint8)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        go = bwt[place] > 0
        owner, place = owner[go], place[go]
        order = np.argsort(bwt, kind="stable")
        piles = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=256))))
        first = bwt[place]
        by = np.argsort(first, kind="stable")  # places ascend, so new suffixes come in sorted order
        owner, place, first = owner[by], place[by], first[by]
        rank = np.empty(len(place), np.int64)
        for symbol, part in c.cut_by(first):
            rank[part] = piles[symbol] + np.searchsorted(order[piles[symbol] : piles[symbol + 1]], place[part])
        ahead, behind = rank > piles[first], rank + 1 < piles[first.astype(np.int64) + 1]
        at = m + rank - piles[1]
        old = np.ones(len(bwt) + len(at), bool)
        old[at] = False
        new_bwt, new_common = np.empty(len(old), np.uint8), np.zeros(len(old), np.uint8)
        new_bwt[old], new_common[old] = bwt, common
        new_bwt[at] = before(owner, j)
        left = order[rank[ahead] - 1] + 1
        new_common[at[ahead]] = np.minimum(_range_least(common, left, place[ahead] + 1).astype(np.int64) + 1, most)
        right = order[rank[behind] + 1] + 1
        new_common[at[behind] + 1] = np.minimum(_range_least(common, place[behind] + 1, right).astype(np.int64) + 1, most)
        bwt, common, place = new_bwt, new_common, at
    n = len(bwt)
    owners, lengths = np.zeros(n, np.int32), np.zeros(n, np.int32)
    step = np.empty(n, np.int64)  # from a suffix to the one that is longer by the symbol before it
    zeros = int((bwt == 0).sum())
    step[np.argsort(bwt, kind="stable")] = np.arange(n) - zeros + m
    owner = place = np.arange(m)
    for j in range(int(sizes.max(initial=0)) + 1):
        owners[place], lengths[place] = owner, j
        go = bwt[place] > 0
        owner, place = owner[go], step[place[go]]
    return owners, lengths, common


def _range_least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Least value of each non-empty [start, stop), by way of the least of whole blocks."""
    if not len(start):
        return np.zeros(0, values.dtype)
    order = np.argsort(start, kind="stable")  # in this order, what lies between the ranges is passed over once
    start, stop = start[order], stop[order]
    top = np.iinfo(values.dtype).max
    whole = np.append(np.minimum.reduceat(values, np.arange(0, len(values), BLOCK)), values.dtype.type(top))
    padded = np.append(values, values.dtype.type(top))
    ranges = lambda v, a, b: np.minimum.reduceat(v, np.stack((a, b), 1).ravel())[::2]
    a, b = -(-start // BLOCK), stop // BLOCK
    wide = a < b
    found = np.full(len(start), top, values.dtype)
    found[~wide] = ranges(padded, start[~wide], stop[~wide]) if not wide.all() else found[:0]
    if wide.any():
        s, e, a, b = start[wide], stop[wide], a[wide], b[wide]
        least = ranges(whole, a, b)
        head = np.where(s < a * BLOCK, ranges(padded, s, a * BLOCK), top)
        tail = np.where(b * BLOCK < e, ranges(padded, np.minimum(b * BLOCK, len(values)), e), top)
        found[wide] = np.minimum(np.minimum(least, head), tail)
    out = np.empty_like(found)
    out[order] = found
    return out


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first byte, end) of the maximal runs of windows whose hash occurs twice or more; no other window
    of these segments can repeat."""
    owner, at, h = _window_hashes(data, offsets, length, _FIRST)
    order = np.argsort(h, kind="stable")
    first = c.starts_of(h[order])
    times = np.diff(np.append(first, len(h)))
    twice = np.zeros(len(h), bool)
    twice[order] = np.repeat(times, times) > 1
    at, owner = at[twice], owner[twice]
    begin = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])))) if len(at) else at
    return owner[begin], at[begin], (at[np.append(begin[1:], len(at)) - 1] + length if len(begin) else at)


def _collection(length: int, blocks: int):
    """Removed intervals that the sorted suffixes of one bucket's segments show. Of runs with equal bytes only the
    earliest enters the collection; the others are removed."""

    def run(segments: pa.Table) -> pa.Table:
        ids, starts = segments.column("id").to_numpy(), segments.column("start").to_numpy()
        data, offsets = c.buffers(segments.column("blob").combine_chunks())
        of, begin, end = _runs(data, offsets, length)
        ids, starts = ids[of], starts[of] + begin - offsets[of]
        order = np.lexsort((starts, ids))
        raw, least, gone = data.tobytes(), {}, []
        for k in order.tolist():
            kept = least.setdefault(raw[begin[k] : end[k]], k)
            if kept != k and (ids[kept], starts[kept]) != (ids[k], starts[k]):
                gone.append(k)
        kept = np.array(list(least.values()), np.int64)
        found_i, found_s, found_e = [ids[gone]], [starts[gone]], [starts[gone] + (end - begin)[gone]]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in least]))).astype(np.int64)
        owner, size, common = sorted_suffixes(np.frombuffer(b"".join(least), np.uint8), bounds, length)
        same = common >= length
        at = np.flatnonzero((size >= length) & (same | np.append(same[1:], False)[: len(same)]))
        if len(at):
            i, s = ids[kept[owner[at]]], starts[kept[owner[at]]] + (np.diff(bounds)[owner[at]] - size[at])
            group = np.cumsum(~same[at])
            order = np.lexsort((s, i, group))
            i, s, group = i[order], s[order], group[order]
            first = c.starts_of(group)
            rank = np.repeat(first, np.diff(np.append(first, len(group))))
            later = (i != i[rank]) | (s != s[rank])
            found_i.append(i[later]), found_s.append(s[later]), found_e.append(s[later] + length)
        return _table(_HIT, [*_removed(blocks, np.concatenate(found_i), np.concatenate(found_s), np.concatenate(found_e))])

    return run


def _shared(length: int, blocks: int):
    """Removed intervals of a collection, or of the windows of one bucket, of which equal ones are settled by their hashes."""
    collection = _collection(length, blocks)

    def run(key: tuple, segments: pa.Table) -> pa.Table:
        if key[0].as_py() == COMPARE:
            return collection(segments)
        i, a, b, s = _open(segments.column("blob"), *_WINDOW_KINDS)
        _, (_, _, i, s) = _first_of_each(a, b, i, s)
        return _table(_HIT, [*_removed(blocks, i, s, s + length)])

    return run


def _joined(i: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (document, start, end), sorted, with neighbours that touch as one; some may still overlap."""
    if not len(i):
        return i, s, e
    new = np.concatenate(([True], (i[1:] != i[:-1]) | (s[1:] > e[:-1])))
    begin = np.flatnonzero(new)
    return i[begin], s[begin], np.maximum.reduceat(e, begin)


def _apply(as_text: bool):
    def run(texts: pa.Table, hits: pa.Table) -> pa.Table:
        ids, starts, sizes = _open(hits.column("blob"), *_PLACE)
        order = np.lexsort((starts, ids))
        ids, starts, stops = ids[order], starts[order], starts[order] + sizes[order]
        own = texts.column("id").to_numpy()
        lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        cols: list = [[], [], [], [], []]
        for d, text in enumerate(texts.column("text")):
            raw = text.as_buffer().to_pybytes()
            s, e = c.merged(starts[lo[d] : hi[d]], stops[lo[d] : hi[d]])
            edges = np.concatenate(([0], np.stack((s, e), 1).ravel(), [len(raw)])).tolist()
            parts = [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]
            kept = "".join(x.decode("utf-8", "ignore") for x in parts) if as_text else b"".join(parts)
            for col, v in zip(cols, (len(raw), int((e - s).sum()), s, e, kept)):
                col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string() if as_text else pa.binary()]
        arrays = [texts.column("id"), *[pa.array(v, k) for v, k in zip(cols, kinds)], texts.column("rest")]
        return pa.table(arrays, names=[*_RESULT, "rest"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, keep: tuple = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans and kept bytes of every document, of its text in UTF-8, and `rest`, a
    struct of the columns in `keep`. With `as_text`, kept is text, without characters that a removal cut.

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a document with a smaller
    id, or in the same one further ahead. All strings are judged on the input. `spans` are the maximal runs of
    removed bytes, [start, end).

    Tasks send a segment's hashes and place, about a fiftieth of the text in number, and of equal segments only
    the earliest; later ones are removed whole. Different segments of an anchor with a context in common send their
    bytes to a collection, where suffixes are sorted column by column and equal strings are neighbours with a common
    prefix of `length` or more. A collection has the anchors of a hash range, so its size follows the number of
    buckets; its arrays stay in the task's memory instead of in files. An anchor with more than SEGMENTS_OF_ANCHOR of
    them sends the hashes of their windows instead, which are segments of one window. Places go packed, by block of documents.

    Null text: empty. Null id: behind all ids; rows that repeat an id do not remove the same place from each
    other. Other columns are ignored."""
    if not GRAM <= length <= 250:
        raise ValueError("length")
    spark = docs.sparkSession
    c.bounded_batches(spark)
    texts = c.texts_of(docs, id_col, text_col)
    n = c.block_count(texts, BLOCK_BYTES)
    blocks = c.odd(n)
    hit, segment = "kind int, key int, size long, blob binary", "kind int, key int, id long, start long, blob binary"
    parcels = texts.mapInArrow(_parcels(length, n, blocks), "kind int, key int, blob binary")
    hits = durable(parcels.groupBy("kind", "key").applyInArrow(_hits(length, blocks), hit))
    c.release(spark)
    keyed = lambda df: df.withColumn("key", c.doc_block(F.col("id"), blocks)).groupBy("key")
    asked = hits.where(F.col("kind") != REMOVED)
    sizes = {r.kind: r.n for r in asked.groupBy("kind").agg(F.sum("size").alias("n")).collect()}  # two rows
    buckets, spread = max(1, -(-sizes.get(COMPARE, 0) // COLLECTION_BYTES)), max(1, -(-sizes.get(SPREAD, 0) // BUCKET_WINDOWS))
    cut = durable(keyed(texts).cogroup(asked.groupBy("key")).applyInArrow(_cut_out(length, buckets, spread, blocks), segment))
    c.release(spark)
    shared = durable(cut.where(F.col("kind") != REMOVED).groupBy("kind", "key").applyInArrow(_shared(length, blocks), hit))
    c.release(spark)
    removed = hits.unionByName(shared).select("kind", "key", "blob").unionByName(cut.select("kind", "key", "blob")).where(F.col("kind") == REMOVED)
    rest = F.struct(*[F.col(k) for k in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    whole = docs.select(*c.text_columns(id_col, text_col), rest.alias("rest"))
    schema = f"id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept {'string' if as_text else 'binary'}, rest {whole.schema['rest'].dataType.simpleString()}"
    found = keyed(whole).cogroup(removed.groupBy("key")).applyInArrow(_apply(as_text), schema)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    return found.select(c.back_to_id().alias("doc_id"), "n_bytes", "n_removed", spans.alias("spans"), "kept", "rest")
