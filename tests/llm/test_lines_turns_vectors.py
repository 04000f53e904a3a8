"""Line deduplication, conversation repair and hard negatives beside brute force."""

import heapq
import itertools
import random
from collections import Counter, defaultdict
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import line_dedup, negatives, repair

WHITE = " \t\n\x0b\x0c\r"

# lines


def brute_lines(rows, least_docs=3, least_chars=20):
    low = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    key = lambda x: x.strip(WHITE).translate(low)
    last = lambda i: 2**63 - 1 if i is None else i
    docs = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(last(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(docs[key(x)]) < least_docs or max(docs[key(x)]) == last(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lines_of(df, **kw):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_repeated_lines(df, **kw).collect())


def line_rows():
    rng = random.Random(3)
    pool = [f"Line number {k} of the notes, {'é' * (k % 5)}" for k in range(30)] + ["short", "", " \t", "ÀÉ" * 10, "a" * 19, "B" * 20, "é" * 19, "é" * 20]
    rows = [(i, "\n".join(rng.choice([str, str.upper, lambda x: f" \t{x}\r"])(rng.choice(pool)) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(None, "\n".join(pool)), (None, pool[0]), (None, None), (61, None), (61, ""), (5, pool[1] + "\n" + pool[1]), (5, pool[2]), (62, "only here, but twice over\n" * 2)]
    rows += [(63, "\n".join(f"a very long text, line {k % 70_000}" for k in range(150_000)))]
    return rows


def test_lines_equal_brute_force(make):
    rows = line_rows()
    assert lines_of(make(rows, extra=True)) == Counter(brute_lines(rows))
    assert lines_of(make(rows), least_docs=2, least_chars=1) == Counter(brute_lines(rows, 2, 1))


def test_lines_by_way_of_the_join(make, monkeypatch):
    """Most lines go through the join when few of them count as frequent; the rows stay as they are."""
    monkeypatch.setattr(line_dedup, "FREQUENT", 2)
    rows = line_rows()[:-1]
    assert lines_of(make(rows)) == Counter(brute_lines(rows))


def test_lines_of_nothing(make):
    assert lines_of(make([])) == Counter()
    assert lines_of(make([(1, None), (2, "")])) == Counter({(1, 1, 0, ""): 1, (2, 1, 0, ""): 1})


# conversations


def cheapest(rows):
    """(cost, edits, repaired rows) by a best-first search over (rows read, state), edits compared as text."""
    start = (0, "", 0, 0, ())
    heap, done = [start], set()
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    given = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    seen = set()
    faults = []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    while heap:
        cost, edits, at, state, told = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if at == len(rows) and state in (0, 3) and (best is None or (cost, edits) < best[:2]):
            best = (cost, edits, told)
        if (edits, at, state) in done or len(edits) > 2 * len(rows) + 3:
            continue
        done.add((edits, at, state))
        role = given[state]
        heapq.heappush(heap, (cost + 3, edits + "I", at, after[state][role[0]], (*told, role + ":")))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, state, told))
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 * (faults[at] == "truncated")
                if role[:1] in after[state]:
                    heapq.heappush(heap, (cost + extra, edits + "K", at + 1, after[state][role[:1]], (*told, f"{role}:{text}")))
                role = given[state]
                heapq.heappush(heap, (cost + 3 + extra, edits + "R", at + 1, after[state][role[0]], (*told, f"{role}:{text}")))
    return best, faults


def told(edits):
    edits = sorted(edits, key=lambda r: r.step)
    assert [r.step for r in edits] == list(range(len(edits)))
    cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[r.edit] + 3 * (r.edit != "D" and r.fault == "truncated") for r in edits)
    return cost, "".join(r.edit for r in edits), tuple(f"{r.role}:{r.text}" for r in edits if r.edit != "D")


def test_repair_equals_the_cheapest_edits(spark):
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", ""], ["Fine.", "Open", "Why?", " \n", "", "No!", "a.b", "x. \t", "é!"]
    convs = {c: [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 5))] for c in range(120)}
    convs[200] = [("system", f"S{k}.") for k in range(5)]
    convs[201] = [("user", f"U{k}.") for k in range(5)]
    convs[None] = [("user", "Hi."), ("assistant", "Ho.")]
    rows = [(c, t, *x) for c, xs in convs.items() for t, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit("clash")).withColumn("step", F.lit("clash")).repartition(5)
    got = defaultdict(list)
    for r in repair.repair(df).collect():
        got[r.conv_id].append(r)
    assert set(got) == set(convs)
    for c, xs in convs.items():
        want, faults = cheapest(xs)
        assert told(got[c]) == want, (c, xs)
        given = sorted((r for r in got[c] if r.given), key=lambda r: r.step)
        assert [r.fault for r in given] == faults and [r.turn for r in given] == list(range(len(xs)))
        pairs = [(a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(xs, xs[1:])]
        assert [r.illegal for r in given] == [False, *pairs]
    costs = repair.repair(df).groupBy("conv_id").agg(F.sum(repair.edit_cost(F.col("edit"), F.col("fault"))).alias("c")).collect()
    assert {r.conv_id: r.c for r in costs} == {c: told(got[c])[0] for c in convs}


def test_repair_takes_nulls_and_repeats(spark):
    rows = [(1, None, None, None), (1, None, "user", "First."), (1, 3, "assistant", "B."), (1, 3, "assistant", "B."), (1, 3, "assistant", "A."), (2, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in repair.repair(df).collect():
        got[r.conv_id].append(r)
    in_order = [(" ", " "), ("user", "First."), ("assistant", "A."), ("assistant", "B."), ("assistant", "B.")]
    assert told(got[1]) == cheapest(in_order)[0] and told(got[2]) == (4, "D", ())
    assert [r.fault for r in sorted(got[1], key=lambda r: r.step) if r.given] == ["blank", None, None, None, "duplicate"]
    assert repair.repair(df.limit(0)).collect() == []


def test_search_holds_only_what_is_undecided():
    """A long conversation keeps a handful of nodes; a tie that lasts is compared from its start."""
    rng = random.Random(2)
    search, most, out = repair.Search(), 0, []
    for k in range(20_000):
        fault = rng.choice([None, None, None, None, "truncated", "duplicate"])
        out += [n.edit for n in search.push(repair.Turn(k, rng.choice(["user", "assistant"]), "x", fault, False))]
        most = max(most, search.open_nodes())
    out += [n.edit for n in search.finish()]
    assert most < 200 and sum(e != "I" for e in out) == 20_000
    search = repair.Search()
    rows = [("system", f"S{k}.") for k in range(6)]
    out = [n.edit for r in rows for n in search.push(repair.Turn(0, *r, None, False))]
    assert search.open_nodes() > 6  # two ways stay as good as each other
    out += [n.edit for n in search.finish()]
    assert "".join(out) == cheapest(rows)[0][1]


# vectors


def test_scores_are_exact():
    rng = np.random.default_rng(4)
    for most, width in ((1, 3), (135, 64), (5000, 200), (1 << 20, 65), (1 << 27, 12), (1 << 30, 2), (7, 0)):
        a, b = rng.integers(-most, most + 1, (40, width)), rng.integers(-most, most + 1, (30, width + 1))
        a[0], b[0] = most, -most
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        assert negatives.scores(a, b).tolist() == want
    every = np.arange(-600, 600)[:, None]
    assert (negatives.scores(every, every) == every * every.T).all()


def brute_negatives(rows, every=50, n_pos=5, n_neg=3, low=50, high=95):
    usable = [(k, i, y, [floor(256.0 * float(x)) for x in v]) for k, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    usable = [r for r in usable if sum(x * x for x in r[3]) < 2**62]
    last = lambda i: 2**63 - 1 if i is None else i
    out = []
    for k, i, y, v in usable:
        if i is None or i % every:
            continue
        all_ = sorted((-sum(a * b for a, b in zip(v, w)), last(j), z, j) for m, j, z, w in usable if m != k)
        for s, _, _, p in [r for r in all_ if r[2] == y][:n_pos]:
            inside = [r for r in all_ if r[2] != y and low * -s <= 100 * -r[0] <= high * -s][:n_neg]
            out += [(i, p, n, r[3], -s, -r[0]) for n, r in enumerate(inside, 1)]
    return Counter(out)


def vector_rows(n=400, dim=6):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) if rng.random() < 0.5 else rng.choice([0.0, 0.5, 1.0]) for _ in range(dim)], rng.randrange(3)) for i in range(n)]
    rows += [(i + n, [0.5] * dim, i % 2) for i in range(150)]  # one vector, many times
    rows += [(50, [0.25] * dim, 1), (50, [0.25] * dim, 1), (100, [], 0), (150, [1.0, 2.0], 2), (None, [1.0] * dim, 0), (None, [1.0] * dim, 1)]
    rows += [(200, None, 1), (250, [1.0, None], 1), (300, [float("nan")], 1), (350, [float("inf")] * dim, 1), (450, [0.1] * dim, None), (500, [1e30] * dim, 0), (550, [1e5] * dim, 0), (551, [9e4] * dim, 1), (-50, [-0.5] * dim, 1)]
    rng.shuffle(rows)
    return rows


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for name in ("id", "uid", "slot", "rank", "score", "block", "vector"):
        df = df.withColumn(name, F.lit("clash"))
    return Counter(tuple(r) for r in negatives.hard_negatives(df, **kw).collect())


@pytest.mark.parametrize("small", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # many blocks of rows and of anchors, tiles smaller than a block
        for name, n in (("BLOCK_ROWS", 64), ("ANCHORS", 4), ("TILE", 3)):
            monkeypatch.setattr(negatives, name, n)
    rows = vector_rows()
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and len(got) > 50
    if not small:
        assert mined(spark, rows, every=7, positives=2, negatives=9, low=20, high=100) == brute_negatives(rows, 7, 2, 9, 20, 100)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == Counter() == mined(spark, [(1, [1.0], 0), (2, [1.0], 1)])
    assert mined(spark, [(0, [1.0], 0), (1, [1.0], 1)]) == Counter()  # an anchor without positives
    assert list(itertools.islice(negatives.PRIMES, 3)) == [1021, 1019, 1013]
