"""Ranked search against a brute-force version, and its blocks and skips by themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from skriva.llm import wand

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, rank string, score string, term string, block string, item_id string"


def terms_of(text):
    return TERM.findall((text or "").translate(LOW))


def by_hand(docs, items, k):
    held = [(i, Counter(t)) for i, t in ((i, terms_of(t)) for i, t, *_ in docs) if t]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for item, query in asked.items():
        scored = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in query.items() if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(["ba", "Ti", "so", "ré", "É", "no", "7"]) for _ in range(rnd.randint(1, 4))) for _ in range(200)]
    docs = [(i, " ".join(rnd.choice(vocab[: 5 + int(rnd.random() ** 2 * 195)]) for _ in range(rnd.choice([0, 2, 20, 200]))), *"abcde") for i in rnd.sample(range(10_000), n)]
    docs += [(None, docs[0][1], *"abcde"), (None, "ba ti", *"abcde"), (20_000, None, *"abcde"), (20_001, "--- \n", *"abcde"), (20_002, docs[3][1], *"abcde"), (20_002, docs[3][1], *"abcde"), (20_003, " ".join(vocab) * 60, *"abcde"), (-5, docs[3][1], *"abcde")]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 5, 40])))) for i in range(30)]
    return docs, items + [(30, None), (31, "!!"), (32, "nowhere here"), (33, docs[3][1]), (34, "ba BA ba ba"), (35, "ti so"), (35, "ba"), (None, "so so ba")]


@pytest.mark.parametrize(("seed", "k", "shard", "span", "most"), [(1, 20, 16 << 20, 1024, 10**6), (2, 3, 4000, 7, 10**6), (3, 5, 20_000, 1, 100), (4, 1000, 9000, 64, 37)])
def test_search(spark, monkeypatch, seed, k, shard, span, most):
    docs, items = corpus(seed)
    for name, value in (("SHARD", shard), ("SPAN", span), ("MOST_TERMS", most), ("BLOCK", 128 if seed == 1 else 4)):
        monkeypatch.setattr(wand, name, value)
    found = wand.index(spark.createDataFrame(docs, SCHEMA).repartition(3))
    got = wand.search(found, spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(docs, items, k)


def test_nothing(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "ba", *"abcde")], SCHEMA)
    items = spark.createDataFrame([(1, "ba ti")], "item_id long, text string")
    assert wand.search(wand.index(none), items).count() == 0
    assert wand.search(wand.index(one), items.limit(0)).count() == 0
    assert [r.doc_id for r in wand.search(wand.index(one), items).collect()] == [1]


@pytest.mark.parametrize("seed", range(5))
def test_blocks_come_back(seed):
    rnd = np.random.default_rng(seed)
    key, doc = [], []
    for k in range(40):
        some = np.unique(rnd.integers(0, int(rnd.choice([5, 400, 100_000])), int(rnd.choice([1, 3, 127, 128, 129, 700]))))
        key += [k] * len(some)
        doc += some.tolist()
    key, doc = np.array(key), np.array(doc)
    tf = rnd.integers(1, rnd.choice([2, 3, 70_000], len(key)))
    made = wand.blocks_of(key, doc, tf, tf * 3)
    for at, n, first, last, top, data in zip(*(made[c] if c != "data" else made[c].to_pylist() for c in ("at", "n", "first", "last", "top", "data")), strict=True):
        docs, counts = wand.unpacked(data, int(n), int(first))
        assert docs.tolist() == doc[at : at + n].tolist() and counts.tolist() == tf[at : at + n].tolist()
        assert (docs[0], docs[-1], counts.max() * 3) == (first, last, top) and len(set(key[at : at + n])) == 1
    assert made["n"].sum() == len(key) and made["n"].max() <= wand.BLOCK


def test_blocks_below_the_threshold_stay_packed():
    """A thousand documents with a common term, few with a rare one: most common blocks are never unpacked."""
    n = 20_000
    tf = np.ones(n, np.int64)
    tf[:200] = 50
    rare = np.arange(0, 200, 10)
    key, doc = np.concatenate([np.zeros(n, np.int64), np.ones(len(rare), np.int64)]), np.concatenate([np.arange(n), rare])
    counts = np.concatenate([tf, np.full(len(rare), 9)])
    sizes = np.full(n, 60)
    top = wand.impacts(counts, sizes[doc], n, 60 * n)
    made = wand.blocks_of(key, doc, counts, top)
    shard = wand.Shard(list(range(n)), sizes.tolist(), n, 60 * n)
    for i in range(len(made["at"])):
        shard.blocks.setdefault("common" if key[made["at"][i]] == 0 else "rare", []).append((*(int(made[c][i]) for c in ("first", "last", "top", "n")), made["data"][i].as_py()))
    shard.close()
    best = wand.Best(20)
    wand.block_max_wand(shard, [("common", 10), ("rare", 5000), ("absent", 7)], best)
    assert best.value.tolist() == rare.tolist()
    assert shard.lists["common"].ready.sum() <= 9 < len(shard.lists["common"].ready) // 10
