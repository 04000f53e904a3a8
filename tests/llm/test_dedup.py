import random
import re
from itertools import combinations

import numpy as np
import pytest

from fleetlens.llm import ngram_join, substring, suffix
from fleetlens.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").encode())


def brute_windows(rows, width=13):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t, *_ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def brute_bytes(rows, length=100):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        spans = re.findall(rb"\x01+", bytes(gone))
        out[i] = (len(b), sum(map(len, spans)), len(spans), bytes(x for x, g in zip(b, gone) if not g))
    return out


def brute_components(rows, width=5):
    sets = {}
    for i, t, *_ in rows:
        w = [x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in words_of(t)]
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_substring_equals_brute_force(make, prose):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(make(prose, extra=True)).collect()}
    assert got == brute_windows(prose)


def test_substring_intervals_are_maximal(make, prose):
    for r in substring.remove_repeats(make(prose)).collect():
        assert sum(x.end - x.start for x in r.intervals) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:]))


def test_suffix_equals_brute_force(make, prose):
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.remove_repeats(make(prose, extra=True)).collect()}
    assert got == brute_bytes(prose)


def test_suffix_with_anchors_taken_apart(make, prose, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENTS_OF_ANCHOR", 1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.remove_repeats(make(prose)).collect()}
    assert got == brute_bytes(prose)


@pytest.mark.parametrize("length", [17, 18, 40, 101, 250])
@pytest.mark.parametrize("most", [1, 2048])
def test_suffix_contexts_of_any_length(make, monkeypatch, length, most):
    """Shared strings around the length, at all distances from what differs, with few letters and with many."""
    monkeypatch.setattr(suffix, "SEGMENTS_OF_ANCHOR", most)
    rng = random.Random(length)
    text = lambda n, letters="abcdefghijklmnop ": "".join(rng.choices(letters, k=n))
    shared = [text(n) for n in (length - 1, length, length + 1, length + 7, 2 * length, 3 * length)] + [text(2 * length, "ab")]
    rows = [(k, text(rng.randint(0, 90)) + rng.choice(shared) + text(rng.randint(0, 90)) + rng.choice(shared)[rng.randint(0, 9) :]) for k in range(60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.remove_repeats(make(rows), length).collect()}
    assert got == brute_bytes(rows, length)


def stored_bytes(monkeypatch):
    """(kind, rows, bytes) of each table that the operator stores, as it goes on."""
    from pyspark.sql import functions as F

    out, durable = [], suffix.durable

    def kept(df):
        df = durable(df)
        size = sum((F.coalesce(F.length(k), F.lit(0)) if t == "binary" else F.lit(8) for k, t in df.dtypes), F.lit(0))
        out.extend((r[0], r[1], r[2]) for r in df.groupBy("kind").agg(F.count(F.lit(1)), F.sum(size)).collect())
        return df

    monkeypatch.setattr(suffix, "durable", kept)
    monkeypatch.setattr(suffix.c, "block_count", lambda *_: 8)  # rows made here have no statistics
    return out


def test_suffix_of_a_common_line_stores_less_than_the_text(make, monkeypatch):
    """A line of 70 bytes among other text makes many segments of one anchor, of which none shares a window."""
    monkeypatch.setattr(suffix, "SEGMENTS_OF_ANCHOR", 20)
    stored, rng = stored_bytes(monkeypatch), random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvw ", k=n))
    line = text(70)
    rows = [(k, text(250) + line + text(250)) for k in range(400)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.remove_repeats(make(rows)).collect()}
    assert got == brute_bytes(rows)
    assert sum(x[2] for x in stored) < sum(len(t) for _, t in rows)


def test_suffix_collections_keep_to_their_size(make, monkeypatch):
    """What one collection sorts does not grow with the segments of common anchors, which are taken apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffix, "SEGMENTS_OF_ANCHOR", 20)
    monkeypatch.setattr(suffix, "COLLECTION_BYTES", 20_000)
    monkeypatch.setattr(suffix.c, "block_count", lambda *_: 8)
    stored, durable, rng = [], suffix.durable, random.Random(8)
    monkeypatch.setattr(suffix, "durable", lambda df: stored.append(durable(df)) or stored[-1])
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvw ", k=n))
    lines = [text(120)] + [text(150) for _ in range(300)]
    rows = [(k, text(90) + lines[0] + text(90) + rng.choice(lines[1:]) + text(90)) for k in range(400)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.remove_repeats(make(rows)).collect()}
    assert got == brute_bytes(rows)
    cut = stored[1].where(F.col("kind") == suffix.COMPARE)
    sizes = [r[1] for r in cut.groupBy("key").agg(F.sum(F.length(dict((t, k) for k, t in cut.dtypes)["binary"]))).collect()]
    assert sizes and max(sizes) < 4 * 20_000


def test_suffix_of_chance_grams_compares_nothing(make, monkeypatch):
    """Grams of 16 bytes that texts share by chance, without a longer string in common, send no text."""
    stored, rng = stored_bytes(monkeypatch), random.Random(9)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvw ", k=n))
    grams = [text(20) for _ in range(30)]
    rows = [(k, "".join(text(70) + rng.choice(grams) for _ in range(8))) for k in range(200)]
    assert {r.doc_id: r.n_removed for r in suffix.remove_repeats(make(rows)).collect()} == {k: v[1] for k, v in brute_bytes(rows).items()}
    assert not [x for x in stored if x[0] in (suffix.COMPARE, suffix.SPREAD)]


def test_suffix_of_copies_stores_places_packed(make, monkeypatch):
    """The places of removed segments of a block of documents are one row."""
    stored, rng = stored_bytes(monkeypatch), random.Random(10)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvw ", k=2000)) for _ in range(40)]
    rows = [(40 * k + i, t) for k in range(12) for i, t in enumerate(texts)]
    assert {r.doc_id: r.n_removed for r in suffix.remove_repeats(make(rows)).collect()} == {i: 2000 * (i >= 40) for i, _ in rows}
    assert sum(x[1] for x in stored) < len(rows) * 2 and sum(x[2] for x in stored) < 0.7 * sum(len(t) for _, t in rows)


def test_suffix_keeps_columns_and_whole_characters(make):
    a = "é" * 120
    out = suffix.remove_repeats(make([(1, a, "fr", "s"), (2, "x" + a + "y", "fr", None)]), as_text=True, keep=("lang", "source")).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert kept[2] == "xy" and len(kept[1]) < 120 and {r.rest.lang for r in out} == {"fr"}


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh"])
def test_sorted_suffixes(alphabet):
    rng = random.Random(3)
    for _ in range(40):
        strings = [bytes(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 9))]
        bounds = np.cumsum([0] + [len(s) for s in strings])
        owner, size, common = suffix.sorted_suffixes(np.frombuffer(b"".join(strings), np.uint8), bounds, 30)
        order = [strings[o][len(strings[o]) - n :] for o, n in zip(owner, size)]
        assert order == sorted(order) and len(order) == sum(len(s) + 1 for s in strings)
        for a, b, k in zip(order, order[1:], common[1:]):
            same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert k == min(same, 30)


def test_ngram_join_equals_brute_force(make, prose):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.group(make(prose, extra=True)).collect()}
    assert got == brute_components(prose)


def test_ngram_join_with_frequent_and_heavy_tokens(make):
    """Many near copies of few texts: prefixes are made of frequent tokens, indexed in pairs."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (30, 60, 150)]
    rows = []
    for i in range(240):
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(t) // 25))):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.group(make(rows), frequent_df=3).collect()}
    assert got == brute_components(rows)


def test_chain_of_links(make):
    """A links with B and B with C, while A and C are too far apart."""
    words = [f"w{i}" for i in range(105)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(9)]
    expected = brute_components(rows)
    assert len({v for _, v in expected.values()}) == 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.group(make(rows)).collect()} == expected


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(300, 299), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[300] == got[299] == 299


def test_empty_and_null_rows(make):
    for f in (substring.remove_repeats, suffix.remove_repeats, ngram_join.group):
        assert f(make([])).collect() == []
        assert len(f(make([(None, None), (None, "a b c d e f"), (1, None), (1, None)])).collect()) == 4


def test_words_made_to_clash(make):
    """A word of 1,024 letters and its mirror in the order of Thue and Morse, which sums of powers cannot tell apart."""
    from fleetlens.llm import common as c

    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    mirror = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(12))
    docs = make([(1, f"{word} {rest}"), (2, f"{mirror} {rest}"), (3, f"{word} a b c d"), (4, f"{mirror} a b c d")])
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == dict.fromkeys(range(1, 5), 0)
    assert all(r.component_id == r.doc_id for r in ngram_join.group(docs).where("doc_id > 2").collect())
    import numpy as np

    words = [b"a" * n for n in range(1, 300)] + [b"a" * n + b"b" for n in range(300)] + [b"b" + b"a" * n for n in range(1, 300)]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    assert len(set(c.word_hashes(data, ends - [len(w) for w in words], ends).tolist())) == len(set(words))
