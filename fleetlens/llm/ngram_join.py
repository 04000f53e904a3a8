"""Jaccard join of documents on word n-grams, with token-combination prefixes.

Of similar sets, both prefixes in one global order of tokens share tokens. Tokens are ordered by frequency.
Rare ones are indexed alone. Frequent ones are dealt to subclasses; pairs of one subclass are indexed, and the
prefix is extended until as many tokens as two similar sets may differ by cannot destroy every signature."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import common as c
from fleetlens.llm.components import components
from fleetlens.session import durable

#: Tokens with a hash below this fraction come first in the order and are counted in all documents.
COUNTED = 0.25
_EDGE = np.uint64(int(COUNTED * 2**64))
#: The other tokens are counted in so many slices of the hash space, to keep a shuffle small.
SLICES = 1
#: Document frequency above which a token is indexed in pairs.
FREQUENT = 64
#: At most so many tokens, the most common of all, are sent to every task. Others lose nothing by not being there.
HEAVY_TOKENS = 1 << 16
#: Bytes of a token's hash that sets are compared by. Two tokens of a pair of sets of 1,000 agree in 6 bytes by
#: chance once in 3e8 pairs, and that matters only for a pair exactly at the threshold.
TOKEN_BYTES = 6
#: 64-bit words of a set's parity bits: one bit a bucket of tokens, set if the set has an odd number of them.
PARITY_WORDS = 16
_PROFILE = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])
_PARCEL = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("blob", pa.binary())])
_SIGNATURE = pa.schema([("sig", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("own", pa.int64())])
_SET = pa.schema([("id", pa.int64()), ("tokens", pa.binary()), ("bits", pa.list_(pa.int64()))])
_VERIFIED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("shared", pa.int64()), ("total", pa.int64())])
DOC, HEAVY, TOKENS, SHARED = 0, 1, 2, 3


def slack(n):
    """How many of its n tokens a set may miss in one whose Jaccard similarity is 0.8 or more."""
    return n - (4 * n + 4) // 5


def band(n: np.ndarray) -> np.ndarray:
    """Sizes within a factor of 0.8 are in the same or in neighbouring bands."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(1.25) + 1e-9).astype(np.int64)


def subclasses(of_band) -> np.ndarray:
    return np.maximum(1, np.round(0.04 * 1.25 ** np.asarray(of_band, float))).astype(np.int64)


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens by document, then hash; their document; the size of each set."""
    data, offsets = c.buffers(batch.column("text"))
    data = c.LOWER[data]
    starts, ends, doc = c.words(data, offsets)
    h, owner = c.distinct_pairs(*c.shingles(c.word_hashes(data, starts, ends), doc, batch.num_rows, width))
    return h, owner, np.bincount(owner, minlength=batch.num_rows)


def _digests(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum(n)))
    out = []
    for salt in (c.U(0x5851F42D4C957F2D), c.U(0x14057B7EF767814F)):
        sums = np.concatenate((np.zeros(1, c.U), np.cumsum(c.mix(h ^ salt))))
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _in_prefix_space(h: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each set the counted tokens, and as many others as a prefix can need."""
    first = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
    place = np.arange(len(h)) - first[owner]
    least = slack(n) + 2 + subclasses(band(n) + 1)
    return (h < _EDGE) | (place < least[owner])


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.steps(batches):
            h, owner, n = _sets(batch, width)
            hi, lo = _digests(h, n)
            ids = batch.column("id").to_numpy()
            _, once = np.unique(np.stack((hi, lo)), axis=1, return_index=True)
            single = np.zeros(len(n), bool)
            single[once] = True
            tokens, counts = np.unique(h[(h < _EDGE) & single[owner]], return_counts=True)
            common = counts >= max(8, len(once) // 64)
            tokens, counts = tokens[common], counts[common]
            z = np.zeros(len(tokens), np.int64)
            yield c.rows(
                _PROFILE, np.repeat(np.array([DOC, HEAVY], np.int32), [len(n), len(z)]), np.concatenate((ids, z)),
                np.concatenate((n, counts)), np.concatenate((hi, tokens.view(np.int64))), np.concatenate((lo, z)),
            )

    return run


def _pack_tokens(kind: int, ids: np.ndarray, h: np.ndarray, extra: np.ndarray, keys: np.ndarray) -> list[tuple]:
    order = np.lexsort((h, ids, keys))
    ids, h, keys = ids[order], h[order], keys[order]
    extra = extra[order] if len(extra) else extra
    out = []
    for key, part in c.cut_by(keys):
        first = c.starts_of(ids[part])
        counts = np.diff(np.append(first, part.stop - part.start)).astype(np.uint32)
        out.append((kind, key, c.pack(ids[part][first], counts, h[part], extra[part].astype(np.uint32) if len(extra) else extra)))
    return out


def _unpack_tokens(blobs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not blobs:
        return np.zeros(0, np.int64), np.zeros(0, c.U), np.zeros(0, np.int64)
    parts = [c.unpack(b.as_buffer(), np.int64, np.uint32, np.uint64, np.uint32) for b in blobs]
    ids = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
    h, extra = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
    return ids, h, extra.astype(np.int64)


def _speakers(ids: np.ndarray, n: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Of documents with equal sets, that with the least id."""
    order = np.lexsort((ids, lo, hi))
    speaks = np.zeros(len(n), bool)
    speaks[order[c.starts_of(hi[order], lo[order])]] = True
    return speaks & (n > 0)


def _parcels(width: int, heavy: np.ndarray, buckets: int, blocks: int):
    """Tokens that a prefix can need, by bucket, and by document its size and its heavy tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.steps(batches):
            h, owner, n = _sets(batch, width)
            ids = batch.column("id").to_numpy()
            speaks = _speakers(ids, n, *_digests(h, n))
            keep = speaks[owner] & _in_prefix_space(h, owner, n)
            h, owner = h[keep], owner[keep]
            place = np.searchsorted(heavy, h)
            is_heavy = heavy[np.minimum(place, len(heavy) - 1)] == h if len(heavy) else np.zeros(len(h), bool)
            plain = ~is_heavy
            counted = np.bincount(owner[plain & (h < _EDGE)], minlength=len(n))
            out = _pack_tokens(TOKENS, ids[owner[plain]], h[plain], np.zeros(int(plain.sum())), c.bucket_of(c.mix(h[plain]), buckets).astype(np.int64))
            own, hv = np.flatnonzero(speaks), np.flatnonzero(is_heavy)
            for kind, i, first, second in ((DOC, ids[own], n[own].astype(c.U), counted[own]), (HEAVY, ids[owner[hv]], h[hv], np.zeros(len(hv), np.int64))):
                out += _pack_tokens(kind, i, first, second, c.doc_block(i, blocks))
            if out:
                yield c.rows(_PARCEL, *zip(*out))

    return run


def _other_tokens(width: int, low: float, high: float, buckets: int):
    """Tokens with hashes in a part of the hash space."""
    low_, high_ = c.U(int(low * 2**64)), c.U(min(int(high * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.steps(batches):
            h, owner, n = _sets(batch, width)
            ids = batch.column("id").to_numpy()
            keep = _speakers(ids, n, *_digests(h, n))[owner] & (h >= low_) & ((h < high_) | (high >= 1))
            h, i = h[keep], ids[owner[keep]]
            out = _pack_tokens(SHARED, i, h, np.zeros(0), c.bucket_of(c.mix(h), buckets).astype(np.int64))
            if out:
                yield c.rows(_PARCEL, *zip(*out))

    return run


def _frequencies(blocks: int):
    """Tokens that two documents or more have, sent to these with their frequency; of the other tokens only how
    many a document shares."""

    def run(key: tuple, parcels: pa.Table) -> pa.Table:
        if key[0].as_py() in (DOC, HEAVY):
            return parcels.select(_PARCEL.names)
        ids, h, _ = _unpack_tokens(list(parcels.column("blob")))
        order = np.lexsort((ids, h))
        ids, h = ids[order], h[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
        ids, h = ids[keep], h[keep]
        first = c.starts_of(h)
        df = np.diff(np.append(first, len(h)))
        df = np.repeat(df, df)
        m = df > 1
        if key[0].as_py() == SHARED:
            own, counts = np.unique(ids[m], return_counts=True)
            out = _pack_tokens(SHARED, own, counts.astype(c.U), np.zeros(0), c.doc_block(own, blocks))
        else:
            out = _pack_tokens(TOKENS, ids[m], h[m], df[m], c.doc_block(ids[m], blocks))
        return pa.Table.from_batches([c.rows(_PARCEL, *zip(*out))] if out else [], _PARCEL)

    return run


def _signatures(n: int, unique: int, h: np.ndarray, df: np.ndarray, heavy: np.ndarray, heavy_rank: np.ndarray, frequent_df: int) -> list[np.ndarray]:
    """Signatures of one set. `h`, `df`: its shared tokens; `heavy`: its heavy ones with their place in the order."""
    need = slack(n) + 1
    counted = h < _EDGE
    a, b = h[counted], h[~counted]
    order = np.lexsort((a, df[counted]))
    a, frequent = a[order], df[counted][order] > frequent_df
    ranked = heavy[np.argsort(heavy_rank)]
    line = np.concatenate((a, ranked, np.sort(b)))
    paired = np.concatenate((frequent, np.ones(len(ranked), bool), np.zeros(len(b), bool)))
    out = []
    for g in (int(band(np.array(n))), int(band(np.array(n))) + 1):
        m = int(subclasses(g))
        sub = (line >> c.U(8)) % c.U(m)
        credit = np.ones(len(line), np.int64)
        pairs = np.flatnonzero(paired)
        if len(pairs):
            _, first = np.unique(sub[pairs], return_index=True)
            credit[pairs[first]] = 0
        reach = np.flatnonzero(unique + np.cumsum(credit) >= need)
        end = int(reach[0]) + 1 if len(reach) else len(line)
        out.append(line[:end][~paired[:end]])
        pairs = pairs[pairs < end]
        for s in np.unique(sub[pairs]):
            mine = np.sort(line[pairs][sub[pairs] == s])
            if len(mine) > 1:
                x, y = np.array(list(combinations(range(len(mine)), 2))).T
                out.append(c.mix(mine[x] * c.BASE + c.mix(mine[y] + c.U(g))))
    return out


def _sign(heavy: np.ndarray, rank: np.ndarray, frequent_df: int):
    def run(key: tuple, parcels: pa.Table, reps: pa.Table) -> pa.Table:
        kinds = parcels.column("kind").to_numpy() if parcels.num_rows else np.zeros(0, np.int32)
        blobs = list(parcels.column("blob"))
        of = {k: _unpack_tokens([b for b, x in zip(blobs, kinds) if x == k]) for k in (DOC, HEAVY, TOKENS, SHARED)}
        ids, n, counted = of[DOC]
        live = np.isin(ids, reps.column("id").to_numpy())
        ids, n, counted = ids[live], n[live].astype(np.int64), counted[live]
        sorted_ = {}
        for k in (HEAVY, TOKENS):
            order = np.argsort(of[k][0], kind="stable")
            sorted_[k] = [x[order] for x in of[k]]
        shared_counted = sorted_[TOKENS][0][sorted_[TOKENS][1] < _EDGE]
        bounds = lambda k: (np.searchsorted(sorted_[k][0], ids, "left"), np.searchsorted(sorted_[k][0], ids, "right"))
        t0, t1 = bounds(TOKENS)
        v0, v1 = bounds(HEAVY)
        unique = counted - (np.searchsorted(shared_counted, ids, "right") - np.searchsorted(shared_counted, ids, "left"))
        # own: tokens that no other set has, of the whole set
        known = np.unique(of[SHARED][0])
        sums = np.bincount(np.searchsorted(known, of[SHARED][0]), weights=of[SHARED][1].astype(float), minlength=len(known) + 1)
        at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
        rest = np.where(known[at] == ids, sums[at], 0).astype(np.int64) if len(known) else np.zeros(len(ids), np.int64)
        own = n - rest - (counted - unique) - (v1 - v0)
        todo = np.flatnonzero((own <= slack(n)) & ((t1 > t0) | (v1 > v0)))
        sigs, owners, sizes, owns = [], [], [], []
        for d in todo:
            mine = sorted_[HEAVY][1][v0[d] : v1[d]]
            part = np.concatenate(_signatures(int(n[d]), int(unique[d]), sorted_[TOKENS][1][t0[d] : t1[d]], sorted_[TOKENS][2][t0[d] : t1[d]], mine, rank[np.searchsorted(heavy, mine)], frequent_df))
            part = np.unique(part)
            sigs.append(part)
            owners.append(np.full(len(part), ids[d]))
            sizes.append(np.full(len(part), n[d]))
            owns.append(np.full(len(part), own[d]))
        if not sigs:
            return pa.Table.from_batches([], _SIGNATURE)
        return pa.Table.from_batches([c.rows(_SIGNATURE, np.concatenate(sigs).view(np.int64), np.concatenate(owners), np.concatenate(sizes), np.concatenate(owns))])

    return run


def _token_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.steps(batches):
            h, owner, n = _sets(batch, width)
            ends = np.cumsum(n)
            short = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN_BYTES :]
            yield c.rows(_SET, batch.column("id"), [short[e - k : e].tobytes() for e, k in zip(ends, n)], _parities(h, owner, len(n)))

    return run


def _parities(h: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    out, buckets = [], 64 * PARITY_WORDS
    for a in range(0, n, 1000):
        b = min(a + 1000, n)
        part = slice(*np.searchsorted(owner, (a, b)))
        odd = np.bincount((owner[part] - a) * buckets + (h[part] % c.U(buckets)).astype(np.int64), minlength=(b - a) * buckets) & 1
        out += list(np.packbits(odd.astype(bool).reshape(b - a, buckets), axis=1).view(np.int64))
    return out


def _wide(tokens: pa.Scalar) -> np.ndarray:
    short = np.frombuffer(tokens.as_buffer(), np.uint8).reshape(-1, TOKEN_BYTES)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :TOKEN_BYTES] = short
    return out.view("<u8").ravel()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, total = [], []
        for a, b in zip(batch.column("a"), batch.column("b")):
            x, y = _wide(a), _wide(b)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            k = int((both[1:] == both[:-1]).sum())
            shared.append(k)
            total.append(len(x) + len(y) - k)
        yield c.rows(_VERIFIED, batch.column("u"), batch.column("v"), shared, total)


def _may_link(x: str, y: str):
    """Whether two sets can be similar, by their sizes n and their numbers of own tokens: they differ by these and
    by the difference of their other tokens at least, and by a ninth of their sizes together at most."""
    n, m, p, q = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}own"), F.col(f"{y}own")
    return 9 * (p + q + F.abs((n - p) - (m - q))) <= n + m


def _few_odd(x: str, y: str):
    """Whether two sets can be similar by their parity bits: where these differ, so do the sets. Telling up to
    sets of some 2,000 tokens; beyond, nothing is ruled out."""
    odd = [F.bit_count(F.get(f"{x}bits", F.lit(k)).bitwiseXOR(F.get(f"{y}bits", F.lit(k)))) for k in range(PARITY_WORDS)]
    return 9 * sum(odd[1:], odd[0]) <= F.col(f"{x}n") + F.col(f"{y}n")


def join(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", frequent_df: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(classes, links): doc_id, n_shingles and rep of every document; the links (u, v) between reps that show
    which classes are connected, with `shared` and `total` shingles.

    All tokens are counted, in slices of the hash space, so that of every set the tokens are known that no other
    set has: a set with too many of them links with nothing, and two sets that differ too much by them, or by
    the number of the others, are not compared. Equal sets form a class, its smallest id is the rep, and only reps are compared. Every candidate pair shares
    a signature. First the least rep of a signature is compared with all others. What this leaves unconnected
    is compared pair by pair, unless distances to the least rep or parity bits rule a link out, so that a group of
    near copies does not list its pairs; links inside a component found already are left out."""
    spark = docs.sparkSession
    c.bounded_batches(spark)
    texts = c.texts_of(docs, id_col, text_col)
    buckets, blocks = c.block_count(texts, 32 << 20), c.odd(c.block_count(texts, 32 << 20))
    profile = durable(texts.mapInArrow(_profile(width), "kind int, id long, n long, hi long, lo long"))
    docs_ = profile.where(F.col("kind") == DOC)
    least = docs_.groupBy("n", "hi", "lo").agg(F.min("id").alias("rep"))
    classes = durable(docs_.join(least, ["n", "hi", "lo"]).select("id", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("rep")).alias("rep")))
    reps = classes.where("id = rep and n > 0").select("id")
    ranked = profile.where(F.col("kind") == HEAVY).groupBy("hi").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hi").limit(HEAVY_TOKENS)
    found = np.array([r.hi for r in ranked.select("hi").collect()], np.int64).view(c.U)
    order = np.argsort(found)
    heavy, rank = found[order], (len(found) - order).astype(np.int64)  # the most common come last
    parcels = texts.mapInArrow(_parcels(width, heavy, buckets, blocks), "kind int, key int, blob binary")
    notes = durable(parcels.groupBy("kind", "key").applyInArrow(_frequencies(blocks), "kind int, key int, blob binary"))
    c.release(spark)
    here = reps.withColumn("key", c.doc_block(F.col("id"), blocks))
    for k in range(SLICES):
        low, high = COUNTED + (1 - COUNTED) * k / SLICES, COUNTED + (1 - COUNTED) * (k + 1) / SLICES
        others = texts.mapInArrow(_other_tokens(width, low, high, buckets), "kind int, key int, blob binary")
        notes = notes.unionByName(durable(others.groupBy("kind", "key").applyInArrow(_frequencies(blocks), "kind int, key int, blob binary")))
        del others
        c.release(spark)
    sigs = durable(notes.groupBy("key").cogroup(here.groupBy("key")).applyInArrow(_sign(heavy, rank, frequent_df), "sig long, id long, n long, own long"))
    c.release(spark)
    least = sigs.groupBy("sig").agg(F.min(F.struct("own", "id", "n")).alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").select("sig", "least")
    shared = durable(sigs.join(least, "sig").select("sig", "id", "n", "own", F.col("least.id").alias("lead"), F.col("least.n").alias("lead_n"), F.col("least.own").alias("lead_own")))
    c.release(spark)
    needed = shared.select("id").distinct()
    sets = durable(texts.join(needed, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_token_sets(width), "id long, tokens binary, bits array<long>"))
    c.release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("id").alias("v"), F.col("tokens").alias("b")), "v")
        whole = left.join(sets.select(F.col("id").alias("u"), F.col("tokens").alias("a")), "u").select("u", "v", "a", "b")
        out = durable(whole.mapInArrow(_verify, "u long, v long, shared long, total long"))
        c.release(spark)
        return out

    stars = shared.where(F.col("id") != F.col("lead")).where(_may_link("", "lead_")).select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct()
    first = verified(stars)
    linked = lambda df: df.where("5 * shared >= 4 * total")
    comps = components(linked(first))
    labelled = shared.join(comps, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    split = labelled.groupBy("sig").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("sig")
    known = first.select(F.col("u").alias("lead"), F.col("v").alias("id"), (1 - F.col("shared") / F.col("total")).alias("far"))
    open_ = durable(labelled.join(split, "sig").where(F.col("id") != F.col("lead")).join(known, ["lead", "id"], "left").join(sets.select("id", "bits"), "id").select("sig", "id", "n", "own", "label", "far", "bits"))
    x, y = open_.alias("x"), open_.alias("y")
    near = F.coalesce(F.abs(F.col("x.far") - F.col("y.far")) <= 0.2 + 1e-9, F.lit(True))
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") < F.col("y.label")) & _may_link("x.", "y.") & near & _few_odd("x.", "y."))
    rest = met.select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v")).distinct()
    second = verified(rest.join(first.select("u", "v"), ["u", "v"], "left_anti"))
    return classes, linked(first).unionByName(linked(second))


def group(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", frequent_df: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links lead to, of every document.

    Two documents link when their sets of `width`-word shingles, in lower case for A-Z, have a Jaccard similarity
    of 0.8 or more. Fewer words than `width` make one shingle; without words (or with a null text) the set is
    empty and links with nothing. doc_id names a document: rows that repeat it belong together, as do those
    without one. Other columns are ignored."""
    classes, links = join(docs, width, id_col, text_col, frequent_df)
    comps = components(links).select(F.col("id").alias("rep"), "component")
    out = classes.join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return out.select(c.back_to_id().alias("doc_id"), F.col("n").alias("n_shingles"), c.back_to_id("component").alias("component_id"))
