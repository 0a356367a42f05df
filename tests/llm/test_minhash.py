"""b-bit MinHash against brute force: classes, estimates, and lists worked through by hubs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skriva.llm import hubs, minhash, shared, toccurrence

from .test_operators import SCHEMA, corpus, words


def classes(sets, percent=85):
    parent = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    return parent


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_join(spark):
    rows = corpus(200, 8)
    sets = [shingles(t) for _, t, *_ in rows]
    parent = classes(sets)
    least = {p: min(r[0] for r, q in zip(rows, parent, strict=True) if q == p) for p in parent}
    got = minhash.join(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = [(r[0], len(s), least[p], r[0] == least[p]) for r, s, p in zip(rows, sets, parent, strict=True)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len({w[2] for w in want}) < len(rows) - 10


def test_odd_input(spark):
    same = "one two three four five six"
    rows = [(None, same, 1), (None, same, 2), (5, same, 3), (5, None, 4), (3, "", 5), (None, "else where", 6), (9, "z " * 20_000, 7), (4, "Else\nWHERE", 8)]
    got = minhash.join(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert Counter(map(tuple, got)) == Counter([(None, 2, 5, False), (None, 2, 5, False), (5, 2, 5, True), (5, 0, 5, True), (3, 0, 3, True), (None, 1, 4, False), (9, 1, 9, True), (4, 1, 4, True)])
    assert minhash.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_hot_group(spark):
    """Near copies with one to six edits of one text, so many lists are long and some of their pairs don't link."""
    rnd = random.Random(2)
    out = []
    for i in range(320):
        own = [f"w{k}" for k in range(150)]
        for k in rnd.sample(range(150), i % 7):
            own[k] = f"x{rnd.randrange(10**9)}"
        out.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash.join(spark.createDataFrame(out, "doc_id long, text string").repartition(4)).collect()}
    assert got == dict(enumerate(classes([shingles(t) for _, t in out])))


def test_minima_by_definition():
    rnd = np.random.default_rng(1)
    sets = [rnd.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 5, 300)]
    got = minhash.minima(np.concatenate(sets), np.array([1, 5, 300]))
    for s, row in zip(sets, got, strict=True):
        for j in (0, 17, 127):
            t, p = int(minhash._TIMES[j]), int(minhash._PLUS[j])
            assert row[j] == min(((int(x) >> 32) * t + p) % 2**32 for x in s)
    words = minhash.packed(got)
    for row, packed in zip(got, words, strict=True):
        assert [int(packed[j // 16]) >> (4 * (j % 16)) & 15 for j in range(minhash.MINIMA)] == [int(x) & 15 for x in row]
    keys = minhash.bands(got)
    same = got.copy()
    same[:, 5] += 1
    assert ((minhash.bands(same) == keys).sum(1) == minhash.BANDS - 1).all()


@pytest.mark.parametrize("true", [0.0, 0.5, 0.85, 1.0])
def test_estimates_are_corrected_for_chance(spark, true):
    rnd = np.random.default_rng(7)
    rows = []
    for _ in range(150):
        n = 400
        union = rnd.integers(0, 2**63, n, dtype=np.uint64)
        k, rest = round(true * n), n - round(true * n)
        a, b = union[: k + rest // 2], np.concatenate([union[:k], union[k + rest // 2 :]])
        x, y = (minhash.packed(minhash.minima(s, np.array([len(s)])))[0].view(np.int64).tolist() for s in (a, b))
        rows.append((x, y))
    found = [r.s for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select(minhash.similarity("a", "b").alias("s")).collect()]
    assert abs(np.mean(found) - true) < 0.015
    if true == 0.85:
        assert min(found) > minhash.LOOSE
    if true == 1.0:
        assert set(found) == {1.0}


@pytest.mark.parametrize("seed", range(2))
def test_hubs_find_every_class(spark, seed):
    """Lists of 2 to 700 members, with few true links hidden in them."""
    rnd = random.Random(seed)
    nodes = [rnd.randrange(-(2**63), 2**63) for _ in range(900)]
    lists = [(k, n) for k in range(30) for n in rnd.sample(nodes, rnd.choice([1, 2, 3, 20, 300, 700]) if k else 700)]
    kind = {n: rnd.randrange(40) for n in nodes}
    tested = []

    def linked(pairs):
        rows = pairs.collect()
        tested.extend((r.a, r.b) for r in rows)
        return pairs.sparkSession.createDataFrame([(r.a, r.b) for r in rows if kind[r.a] == kind[r.b]], "a long, b long")

    about = spark.createDataFrame([(n, kind[n]) for n in nodes], "sig long, kind int")
    fits = F.abs(F.col("kind") - F.col("hub.kind")) < 3
    comp = {r.node: r.comp for r in hubs.classes(spark.createDataFrame(lists, "key long, sig long"), about, fits, linked).collect()}
    parent = {n: n for n in nodes}
    by_list = {}
    for k, n in lists:
        by_list.setdefault((k, kind[n]), []).append(n)

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for some in by_list.values():
        for n in some[1:]:
            a, b = sorted((root(some[0]), root(n)))
            parent[b] = a
    assert {n: comp.get(n, n) for n in nodes} == {n: root(n) for n in nodes}
    assert all(a != b and abs(kind[a] - kind[b]) < 3 for a, b in tested)


def test_sketches_of_a_set_met_before(spark):
    docs = spark.createDataFrame([(i, "a b c d e f", ) for i in range(5)], "doc_id long, text string").coalesce(1)
    got = minhash.sketches(docs).collect()
    assert sum(r.bits is not None for r in got) == 1 and len({r.sig for r in got}) == 1
    bits = next(r for r in got if r.bits is not None)
    assert len(bits.bits) == minhash.WORDS and len(set(bits.bands)) == minhash.BANDS


def test_recall_at_the_threshold(spark):
    """Pairs of exactly 0.85: 170 shared of 200."""
    rnd = random.Random(3)
    out = []
    for i in range(120):
        t = [f"d{i}w{k}" for k in range(189)]
        a, b = t, t[:174] + [f"e{i}w{k}" for k in range(rnd.choice([15, 14]))]
        out += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {r.doc_id: r.component_id for r in minhash.join(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(classes([shingles(t) for _, t in out])))
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(120)) > 30


@pytest.mark.parametrize("join", [minhash.join, toccurrence.join])
def test_the_graph_is_not_broadcast(spark, monkeypatch, join):
    """Sides of its joins that are below Spark's threshold would stay in the driver's memory, round after round."""
    monkeypatch.setattr(toccurrence, "MOST_BROADCAST", -1)
    runs = lambda: (lambda x: [x.apply(i) for i in range(x.size())])(spark._jsparkSession.sharedState().statusStore().executionsList())
    before = {r.executionId() for r in runs()}
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[: i + 1], f"x{i}", *words[i + 1 :]])) for i in range(6)] + [(9, "another text")]
    got = join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(6)] + [(9, 9)]
    plans = [r.physicalPlanDescription() for r in runs() if r.executionId() not in before]
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]


def test_the_driver_broadcasts_ids_alone(spark, monkeypatch):
    """Who asks for a text isn't sent through the driver, and each id is once, however many ask; ids may be null."""
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(toccurrence, "BLOCK", 4)
    monkeypatch.setattr(toccurrence.F, "broadcast", lambda df: sent.append((df.columns, df.count())) or broadcast(df))
    common = " ".join(f"w{i}" for i in range(60))
    rows = [(None if i == 3 else i, f"{common} x{i}") for i in range(40)] + [(100 + i, f"a{i} b{i} c{i} d{i}") for i in range(20)]
    got = toccurrence.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got) == sorted((i is None, i or 0, 0 if i is None or i < 40 else i) for i, _ in rows)
    assert sent and all(columns == ["key"] and n <= 40 for columns, n in sent)


def test_small_checkpoints_are_read_in_few_tasks(spark):
    rows = shared.kept(spark.range(1000).repartition(64))
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and rows.count() == 1000
    shared.drop(rows)
