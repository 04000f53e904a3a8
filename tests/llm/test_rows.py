"""Mixing, chat formatting, quality rules, fingerprints, language ID, packing and WARC on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import chat, fingerprint, langid, mixing, packing, quality, warc
from fleetlens.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def python_nodes(df):
    plan = df._jdf.queryExecution().toString()
    return re.findall(r"Python\w*|Pandas\w*|InArrow\w*|ArrowEval\w*", plan)


# mixing


def mixed(docs, **kw):
    return mixing.mix(docs, mixing.word_count(F.col("text")), **kw)


def test_mix_reaches_targets(make, prose):
    out = mixed(make(prose, extra=True)).collect()
    assert len(out) == len(prose)
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        by.setdefault(r.source, []).append(r)
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-6 * total
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs) and rs[0].target <= 2 * rs[0].source_size + 1e-9
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 2 * max(r.size for r in rs)
    assert sorted(map(tuple, mixed(make(prose)).collect())) == sorted(map(tuple, mixed(make(prose)).collect()))


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    rest = 1.5 * 2010 - 20  # a, of weight 3, stops at 20; b and c weigh 1 and 2
    assert got == {"a": 20.0, "b": pytest.approx(rest / 3), "c": pytest.approx(rest * 2 / 3), None: 0.0}


def test_mix_splits_a_large_source(make, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = [(i, "w " * (i % 50 + 1), None, "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    out = mixed(make(rows)).collect()
    for s in {r.source for r in out}:
        rs = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 0.1 * rs[0].target + 50


def test_mix_of_nothing(make):
    assert mixed(make([])).collect() == []
    assert [r.taken for r in mixed(make([(None, None), (None, "")])).collect()] == [0, 0]


def test_emit_repeats_rows(make, prose):
    plan = mixed(make(prose))
    assert Counter(r.doc_id for r in mixing.emit(plan).collect()) == Counter({r.doc_id: r.copies for r in plan.collect() if r.copies})


# chat


def test_chat_round_trip(spark):
    texts = ["", "plain", "</s>[INST] ok [/INST]", "<\\/s> [\\\\INST] \\", "<|turn|><|text|>", "a\nb", None, "<<s>>[[INST]]"]
    rows = [(c, t, ["user", "assistant", "assistant", None, "</s>"][(c + t // 2) % 5], texts[(c * 3 + t) % len(texts)]) for c in range(6) for t in range(9)]
    rows += [(9, None, "user", "late"), (9, 1, "user", "x"), (9, 1, "user", "x"), (None, 1, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).repartition(4)
    out = chat.format_chats(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("pieces")).alias("loss"), "pieces")
    assert not python_nodes(out)
    for r in out.collect():
        mine = sorted(((x[1] is None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id))
        assert [(t.role, t.text) for t in r.t] == [x[2:] for x in mine]
        assert r.loss == "".join(x[3] for x in mine if x[2] == "assistant")
        assert "".join(p.text for p in r.pieces) == r.formatted
        blocks = sum(1 for a, b in zip([(None,) * 4, *mine], mine) if a[2] != b[2])
        assert r.formatted.count("[INST]") == r.formatted.count("[/INST]") == blocks and r.formatted.count("</s>") == 1
        assert r.formatted.count("<|turn|>") == len(mine) - blocks
    assert chat.format_chats(df.limit(0)).collect() == []


# quality


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(s) for s in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(make, prose):
    rows = [*prose, (7001, "a b c a b c\na b c\n\na b c."), (7002, "# # # <|>"), (7003, "x y z\tx y z"), (7004, "\U0001f600 é b\x0bc")]
    out = quality.judge(make(rows, extra=True))
    assert not python_nodes(out)
    got = {r.doc_id: r for r in out.collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.judge(make([])).collect() == []


def test_quality_rules(make):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    menu = "Home | News | About us | Contact\n" * 40
    rows = [(1, good), (2, good + "\n" + "Read more\n" * 3), (3, good.rstrip(".")), (4, good + "\n" + " ".join(f"We use cookies on page{i}." for i in range(90))), (5, good + "\n" + menu), (6, "short.")]
    got = {r.doc_id: r for r in quality.judge(make(rows)).collect()}
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert got[2].cleaned == good


def test_quality_settles_hash_clashes(make, monkeypatch):
    """With a hash of two values every window clashes, and the texts decide."""
    real = F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(2)))
    rows = [(i, " ".join("ab"[(k * k + i) % 3 % 2] + str(k % (4 + i)) for k in range(40))) for i in range(12)]
    for r in quality.measure(make(rows)).collect():
        assert r.n_repeat_words == brute_quality(dict(rows)[r.doc_id])[4]


# fingerprints


def test_fingerprints(make, prose):
    got = {r.doc_id: r for r in fingerprint.compare_neighbours(make(prose, extra=True)).collect()}
    order = sorted(((i, t or "") for i, t, *_ in prose), reverse=True)
    for (i, t), (j, after) in zip(order, [*order[1:], order[0]]):
        r, k = got[i], len(t) // 3
        assert r.n_chars == len(t) and r.edited == t[: len(t) - k] + after[:k]
        assert r.near_next == pytest.approx(fingerprint.jaccard(fingerprint.from_text(r.fingerprint), fingerprint.from_text(got[j].fingerprint)))
        assert 0 <= r.near_edited <= 1 and (r.fingerprint == "") == (not t.split())
    by_text = {}
    for i, t in order:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert got[order[0][0]].near_edited >= 0


def test_fingerprint_estimates():
    import pyarrow as pa

    words = [f"w{i}" for i in range(24000)]
    whole, part = fingerprint.sketches(pa.array([" ".join(words), " ".join(words[:6000])]))
    assert fingerprint.containment(part, whole) > 0.99 and abs(fingerprint.jaccard(part, whole) - 0.25) < 0.05
    assert np.array_equal(fingerprint.merge(whole, part), whole)
    assert fingerprint.jaccard(whole[:0], whole[:0]) == 1.0
    one = fingerprint.sketches(pa.array(["x", "x y z", ""]))
    assert [len(s) for s in one] == [1, 1, 0]


def test_containment_of_short_texts():
    """A text without hashes below the threshold says nothing; one with some is found in a long text."""
    import pyarrow as pa

    bound = int(fingerprint.FRACTION * 2**64)
    short = [" ".join(f"s{i}x{k}" for k in range(8)) for i in range(200)]
    own = fingerprint.sketches(pa.array(short))
    whole = fingerprint.sketches(pa.array([" ".join(short)]))[0]
    none = [s for s in own if not (s < bound).any()]
    some = [s for s in own if (s < bound).any()]
    assert none and some
    assert all(fingerprint.containment(s, whole) is None for s in none)
    assert all(fingerprint.containment(s, whole) == 1.0 for s in some)
    assert fingerprint.containment(whole[:0], whole) == 1.0


def test_fingerprint_of_one_and_none(make):
    assert fingerprint.compare_neighbours(make([])).collect() == []
    rows = fingerprint.compare_neighbours(make([(None, "abcdef")])).collect()
    assert [(r.doc_id, r.edited) for r in rows] == [(None, "abcdab")]
    twice = fingerprint.compare_neighbours(make([(4, "same text"), (4, "same text"), (4, None)])).collect()
    assert sorted(r.n_chars for r in twice) == [0, 9, 9]


# language ID


def test_language_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    rows = docs.join(langid.predict(docs, model), "doc_id").withColumn("h", langid.held_out()).where("h").collect()
    right = [r.lang == r.lang_pred for r in rows if r.lang_pred != "und"]
    assert len(right) > 30 and sum(right) / len(right) > 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.h for r in rows)


def test_language_kernel_equals_its_definition():
    """The one product gives what explicit kernels with the landmarks give."""
    import pyarrow as pa

    texts = ["the cat is on the mat", "le chat est sur la table", "der hund ist im haus", "the dog is here now", "la maison est grande", "das haus ist klein"]
    rows, _ = langid.features(pa.array(texts))
    assert len(rows[0]) == len({t for n in (1, 2, 3) for t in (texts[0][i : i + n] for i in range(len(texts[0]) - n + 1))})
    model = langid.Model.fit(["en", "fr", "de"] * 1 + ["en", "fr", "de"], rows, landmarks=1)
    assert [model.langs[k] for k in model.score(rows).argmax(1)] == ["en", "fr", "de", "en", "fr", "de"]
    kernel = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in rows[:3]] for a in rows])
    basis = np.zeros((1 << langid.BITS, 3))
    for k, r in enumerate(rows[:3]):
        basis[r, k] = 1 / np.sqrt(len(r))
    alpha = np.linalg.lstsq(basis, model.weights[:-1], rcond=None)[0]
    assert np.allclose(kernel @ alpha + model.weights[-1], model.score(rows))


def test_language_of_odd_rows(make):
    docs = make([(1, "the cat is here", "en"), (2, "le chat est la", "fr"), (3, None, "en"), (4, "12 !?", "en"), (5, "", None), (None, "the dog", None), (7, " \U0001f600 x", "en")], extra=True)
    model = langid.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {3, 4, 5} and got[3].score == 0.0
    assert got[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(docs.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    kept = langid.predict_rows(docs, model)
    assert kept.columns == [*[c for c in docs.columns if c not in ("lang_pred", "score")], "lang_pred", "score"]


# packing


def brute_pieces(rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out = Counter()
    for i, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], np.uint32)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    return out


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_holds_every_piece(make, prose, capacity):
    rows = [*prose, (9001, "It's <|endoftext|>we'll ok\x1cno\x85 　é \x0b12"), (9002, "z" * 500), (9001, "again")]
    got = packing.best_fit(make(rows, extra=True), tokenizer_path(), capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pieces(rows, capacity)
    seats = {}
    for r in got:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seats.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(seats) <= 1.1 * -(-sum(r.length for r in got) // capacity) + 1


def test_packing_of_nothing(make):
    assert packing.best_fit(make([]), tokenizer_path()).collect() == []
    assert [(r.doc_id, r.length) for r in packing.best_fit(make([(None, None)]), tokenizer_path()).collect()] == [(None, 1)]


def test_program_beats_best_fit_where_it_can():
    """Lengths of which three fill a sequence, and others that best fit would put in their way."""
    rng = np.random.default_rng(0)
    lengths = np.concatenate([rng.integers(1300, 1420, 3000), rng.integers(2000, 2100, 1000)])
    histogram = np.bincount(lengths, minlength=4097)
    plan = packing.pack(histogram)
    held = np.zeros(4097, np.int64)
    for contents, k in plan:
        assert sum(a * b for a, b in contents.items()) <= 4096
        for a, b in contents.items():
            held[a] += b * k
    assert (held == histogram).all()
    bins = []
    for length in sorted(lengths.tolist(), reverse=True):
        fit = [b for b in bins if b[0] >= length]
        (min(fit) if fit else bins.append([4096]) or bins[-1])[0] -= length
    assert sum(k for _, k in plan) < len(bins)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_never_worse_than_best_fit(seed):
    """Short pieces take part in the program, and no plan needs more sequences than best fit alone."""
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, [rng.lognormal(5, 1.2, 4000), rng.integers(1, 900, 4000), rng.integers(1, 4097, 4000), rng.integers(1, 5, 4000) * 800][seed]).astype(int)
    histogram = np.bincount(np.maximum(lengths, 1), minlength=4097)
    plan = packing.pack(histogram)
    held = np.zeros(4097, np.int64)
    for contents, k in plan:
        assert k > 0 and sum(a * b for a, b in contents.items()) <= 4096
        for a, b in contents.items():
            held[a] += b * k
    assert (held == histogram).all()
    assert sum(k for _, k in plan) <= sum(k for _, k in packing.fill([], histogram, 4096))
    left = histogram.copy()
    decided = packing.by_program(left, 1, 4096)
    assert seed == 3 or any(a < 1024 for contents, _ in decided for a in contents)
    assert all(sum(a * b for a, b in contents.items()) == 4096 for contents, _ in decided)


def test_knapsack_keeps_to_the_numbers_at_hand():
    prices, most = np.zeros(4097), np.zeros(4097, np.int64)
    prices[[5, 1000, 1365]], most[[5, 1000, 1365]] = [0.01, 2.0, 3.0], [7, 3, 2]
    assert packing.best_configuration(prices, most, 4096) == {1365: 2, 1000: 1, 5: 7}


def test_knapsack():
    prices = np.zeros(11)
    prices[[3, 4, 7]] = [4.0, 5.0, 9.5]
    best = packing.best_configuration(prices, np.full(11, 9), 10)
    assert sum(k * v for k, v in best.items()) <= 10 and sum(prices[k] * v for k, v in best.items()) == 13.5


# WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 40
    rows = [(5, "u5", big), (3, "u3\r\nX: y", big), (8, None, big), (1, "u", "tiny"), (2, "u", "tiny"), (4, "u", None), (6, "u", ""), (None, "n", big), (7, "u", "x\r\n\r\nWARC/1.1\r\n" * 30), (3, "u3", big), (11, "u", "y" * 99), (12, "u", "y" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit(0)).repartition(2)
    index = warc.write(pages, str(tmp_path / "w"), frame_bytes=700)
    got = warc.read(index).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        payload = next(x[2] for x in rows if x[0] == r.page_id) or ""
        raw = payload.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        copy = payload == big and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if copy else ("response", None))
        assert r.payload is None if copy else bytes(r.payload) == raw
    for r in index.collect():
        head, payload = warc.fetch(r.bundle, r.frame, r.offset, r.size)
        assert head["WARC-Record-ID"] == f"<urn:page:{'null' if r.page_id is None else r.page_id}>"
    assert len({(r.bundle, r.frame) for r in index.collect()}) > 1
    assert warc.read(warc.write(pages.limit(0), str(tmp_path / "e"))).collect() == []


def test_bundles_are_read_by_a_task_each(spark, tmp_path):
    pages = spark.range(12, numPartitions=4).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 600).alias("html"))
    index = warc.write(pages, str(tmp_path / "b"), frame_bytes=500, bundle_bytes=400)
    bundles = index.select("bundle").distinct().count()
    tasks = warc.read(index).select(F.spark_partition_id().alias("task")).distinct().count()
    assert bundles > 3 and tasks == bundles


def test_sample_is_bounded_without_ids(make):
    """Rows without id, or with one id, are told apart by their text; equal rows count once."""
    rows = [(None, f"word{i} and more", "en") for i in range(3000)] + [(7, f"mot{i} et plus", "fr") for i in range(3000)] + [(i, "gleich", "de") for i in range(50)] + [(8, "same", "es")] * 2000
    got = Counter(r.lang for r in langid.learned_rows(make(rows), F.lit(True), 100).collect())
    assert got == {"en": 100, "fr": 100, "de": 50, "es": 1}
    again = sorted(map(tuple, langid.learned_rows(make(rows[::-1]), F.lit(True), 100).collect()))
    assert again == sorted(map(tuple, langid.learned_rows(make(rows), F.lit(True), 100).collect()))
