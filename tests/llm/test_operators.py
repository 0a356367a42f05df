"""Each operator against a brute-force version, on texts that are null, empty, long, repeated and tied."""

import dataclasses
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skriva.llm import chat, compact, decontam, idcodec, langid, lm, mixing, quality, queries, shared, sitetree, toccurrence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, key string, score string, spans string"


def corpus(n=160, seed=3):
    rnd = random.Random(seed)
    words = {"en": "the of and to in is that it was for on are with as his they at be this from".split(), "fr": "le la et les des en un du une que est pour qui dans au sur par été à où".split()}
    vocab = ["".join(rnd.choice(["ba", "ti", "so", "ré", "mu", "ÉL", "Ka", "no"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    out, base = [], [rnd.choice(vocab) for _ in range(300)]
    for i in range(n):
        lang = rnd.choice(["en", "fr"])
        t = " ".join(rnd.choice(vocab + words[lang] * 4) for _ in range(rnd.choice([3, 30, 90, 400])))
        if i % 7 == 1:
            own = list(base)
            for _ in range(i % 5 * 2):
                own[rnd.randrange(len(own))] = "edit%d" % rnd.randrange(10**6)
            t = " ".join(own)
        if i % 11 == 2:
            t = t.replace(" ", "\n", 3) + "\n# $ dup\n# $ dup\n"
        if i % 13 == 3:
            t += " " + " ".join(base[40:110]) + " tail"
        out.append((i, t, lang))
    out += [(900, None, "en"), (901, "", None), (902, " \n\t ", "fr"), (903, "12 34", "en"), (904, out[1][1], "en"), (905, out[1][1], "en"), (905, out[1][1], "en"), (906, "x" * 9000 + " é", "en"), (907, " ".join(vocab) * 40, "fr")]
    return [(i, t, lang, "s", None, "n", "k", "s", "x") for i, t, lang in out]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def test_hashes_of_words():
    texts = ["Aé b", "", "b  Aé x", "b"]
    data = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    starts, ends, n = shared.spans(buf, off)
    assert n.tolist() == [2, 0, 2, 1]
    h = shared.hashes(buf, starts, ends)
    assert h[1] == h[2] == h[4] and h[0] != h[3]
    keys, made = shared.shingles(h, n, 2)
    assert made.tolist() == [1, 0, 1, 1] and keys[2] != keys[1]


def test_ngram_join(docs, rows, nothing):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = sorted(tuple(r) for r in toccurrence.join(docs).collect())
    assert got == sorted((i, len(sets[i]), root(i)) for i, *_ in rows)
    assert toccurrence.join(nothing).count() == 0


def test_ngram_join_odd_input(spark):
    same = "one two three four five"
    rows = [(None, same, 1), (None, same, 2), (5, same, 3), (5, None, 4), (3, "", 5), (None, "else where", 6), (9, "z " * 20_000, 7)]
    got = toccurrence.join(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert Counter(tuple(r) for r in got) == Counter([(None, 2, 5), (None, 2, 5), (5, 2, 5), (5, 0, 5), (3, 0, 3), (None, 1, None), (9, 1, 9)])


@pytest.mark.parametrize("seed", range(6))
def test_divide_skip(seed):
    rnd = np.random.default_rng(seed)
    pick = lambda n: np.unique(rnd.integers(0, 60, n).astype(np.uint64))
    query = pick(50)
    members = [query if i % 9 == 0 else np.setdiff1d(query, pick(4)) if i % 2 else pick(50) for i in range(40)]
    want = [i for i, m in enumerate(members) if 100 * len(np.intersect1d(query, m)) >= 85 * len(np.union1d(query, m))]
    assert sorted(toccurrence.divide_skip(query, members)) == want


def test_hot_list_is_joined_in_rounds(spark):
    """Over 260 sets share a rare list, and most of its pairs don't link."""
    rnd = random.Random(1)
    out = []
    for i in range(280):
        own = [f"w{k}" for k in range(100)]
        for k in rnd.sample(range(100), i % 4):
            own[k] = f"x{rnd.randrange(10**9)}"
        out.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in toccurrence.join(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    sets = [{tuple(w[k : k + 4]) for k in range(97)} for w in (t.split() for _, t in out)]
    parent = list(range(280))
    for a in range(280):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    assert got == dict(enumerate(parent))


BENCH = [(1, " ".join("item word%d" % i for i in range(9))), (2, "Short Item here"), (3, ""), (4, None), (10, "ba ti so ba ti so ba ti so ba ti so")]


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    more = [(1, "a, SHORT item. here! " + BENCH[0][1].upper() + " end"), (2, BENCH[0][1][:40]), (3, None), (3, None), (4, "short item hereafter"), (5, " ".join(["ba ti so"] * 6)), (6, "short item here"), (6, "short item here")]
    df = spark.createDataFrame(more, "doc_id long, text string")
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = defaultdict(set)
    for i, t in BENCH:
        w = token.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t in more:
        w, hit, own = token.findall((t or "").translate(LOW)), set(), set()
        for g, names in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    own |= names
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    assert sorted(tuple(r) for r in decontam.report(df, items).collect()) == sorted(want)
    assert sorted(r.doc_id for r in decontam.remove(df, items).collect()) == [2, 3, 3, 4]
    cut = {r.doc_id: r.text for r in decontam.remove(df, items, "span").collect()}
    assert cut[1] == "a end" and cut[6] == "" and cut[4] == "short item hereafter" and cut[3] is None
    assert decontam.report(nothing, items).count() == 0 and decontam.report(docs, items.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_codec(seed):
    rnd = np.random.default_rng(seed)
    ranks = (rnd.integers(0, 2**32, 997 + seed, dtype=np.uint64) >> rnd.integers(0, 32, 997 + seed).astype(np.uint64)).astype(np.uint32)
    control, data = idcodec.pack(ranks)
    assert (idcodec.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)) == ranks).all()
    made = idcodec.block(3, 0, 7, [None, 5], np.array([900, len(ranks) - 900]), ranks) + b"\n"
    (bucket, before, ids, counts, back) = next(idcodec.blocks(made + made))
    assert (bucket, before, ids, counts.tolist()) == (3, 7, [None, 5], [900, len(ranks) - 900]) and (back == ranks).all()


def test_encoder_is_the_library():
    coder = idcodec.Encoder(queries.vocabulary())
    rnd = random.Random(8)
    bits = [" ", "  ", "\n", "\t", "\xa0", "a", "é", "à", "'s", "don't", "12", "²", ".", ",", "!", "　", "<|endoftext|>", "漢", "😀", "\x1c", "\r\n", "\0", " ", " Hello", " wörld,", "x.\ny"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["z" * 500]
    for own, buf, off in shared.pieces([pa.record_batch({"text": texts})]):
        ids, n = coder.texts(buf, off)
        want = [e.ids for e in coder.library.encode_batch(own.column(0).to_pylist(), add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_token_ids(spark, docs, rows, nothing):
    folder = idcodec.encode(docs, queries.vocabulary())
    library = idcodec.Encoder(queries.vocabulary()).library
    at, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in idcodec.digests(spark, folder).collect()) == want
    # the files stand alone: another session reads them
    assert sorted(tuple(r) for r in idcodec.digests(spark.newSession(), folder).collect()) == want
    back = {(r.doc_id, r.start): np.frombuffer(r.ids, "<u4").tolist() for r in idcodec.read(spark, folder).collect()}
    assert sorted(library.decode(x[:-1]) for x in back.values()) == sorted(t or "" for _, t, *_ in rows)
    assert idcodec.digests(spark, idcodec.encode(nothing, queries.vocabulary())).count() == 0
    odd = spark.createDataFrame([(3, "b", 1), (None, "a", 2), (None, None, 3), (3, "b", 4)], "doc_id long, text string, start int")
    got = sorted(((r.doc_id is not None, r.start, r.n_tokens) for r in idcodec.digests(spark, idcodec.encode(odd, queries.vocabulary())).collect()), key=repr)
    assert got == [(False, 0, 1), (False, 1, 2), (True, 3, 2), (True, 5, 2)]


def test_quality(docs, rows, nothing):
    want = {}
    for i, t, *_ in rows:
        t = t or ""
        w, seen, dup, hit = WORD.findall(t), set(), 0, set()
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        for k in range(len(w) - 2):
            hit |= {k, k + 1, k + 2} if grams[tuple(w[k : k + 3])] > 1 else set()
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want[i] = (len(w), sum(map(len, w)), sum(t.count(c) for c in quality.SYMBOLS), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))
    got = quality.apply(docs).collect()
    assert len(got) == len(rows) and all(tuple(r)[1:7] == want[r.doc_id] and not (r.base_failed and r.kept) for r in got)
    orders = [quality.apply(docs, list(o)).orderBy("doc_id").collect() for o in (quality.RULES, reversed(quality.RULES))]
    assert orders[0] == orders[1] and quality.apply(nothing).count() == 0 and sorted(quality.plan(docs)) == sorted(quality.RULES)


def test_language(docs, nothing):
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs), ["doc_id", "lang", "score"], ("p", "s")).collect()}
    assert all(got[i].p == "und" and got[i].s == 0 for i in (900, 901, 902, 903))
    long = [r for i, r in got.items() if i < 160 and i % 7 != 1]
    assert sum(r.p == r.lang for r in long) > 0.85 * len(long) and all(0 <= r.s <= 1 for r in got.values())
    assert {r.p for r in langid.predict(docs, langid.train(nothing), ["doc_id"], ("p", "s")).collect()} == {"und"}


def test_language_by_counting(docs, rows):
    """Every posterior anew: counts of hashed 2- and 3-grams of letters by language, in Python integers."""

    def grams(t):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t or "")
        for k in langid.ORDERS:
            for i in range(len(low) - k + 1):
                h = k
                for c in low[i : i + k]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
                yield (h * 0x85EBCA6B & 0xFFFFFFFF) >> 16

    count, n = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        if lang is not None:
            count[lang].update(grams(t))
            n[lang] += 1
    size = {x: sum(c.values()) for x, c in count.items()}
    names = sorted(n)
    got = {(r.doc_id, r.n_words): r for r in langid.predict(docs.withColumn("n_words", F.length("text")), langid.train(docs), ["doc_id", "n_words"], ("p", "s")).collect()}
    for i, t, *_ in rows:
        log = [math.log(n[x] / sum(n.values())) + sum(math.log((count[x][g] + langid.SMOOTHING) / (size[x] + langid.SMOOTHING * langid.BUCKETS)) for g in grams(t)) for x in names]
        r = got[i, None if t is None else len(t)]
        if not any(c.isalpha() for c in t or ""):
            assert (r.p, r.s) == ("und", 0)
            continue
        top = max(log)
        assert r.p == names[log.index(top)] and abs(r.s - 1 / sum(math.exp(x - top) for x in log)) < 1e-3


def test_language_model(spark, docs, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    split = {(i, t): [*words(t), None] for i, t, *_ in rows}
    count = Counter(w for i, t, *_ in rows if not held(i) for w in split[i, t])
    n, v = sum(count.values()), len(count)
    out = queries._fold(7) == 2
    texts, tokens = lm.tokenised(docs, out, queries.vocabulary())
    model, counted, total = lm.fit(texts, tokens, queries.vocabulary())
    got = lm.scores(texts, (model, counted, total), "<u2").collect()
    want = Counter((i, held(i), len(split[i, t]), sum(count[w] > 0 for w in split[i, t]), n) for i, t, *_ in rows)
    assert Counter(tuple(r)[:5] for r in got) == want
    base = {i: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split[i, t]) for i, t, *_ in rows}
    assert all(abs(r.base_score - base[r.doc_id]) < 1e-6 * abs(base[r.doc_id]) and r.score < 0 for r in got)
    # each text's score anew: its words' ids one text at a time, mixed with the words' exact shares
    coder = idcodec.Encoder(queries.vocabulary())
    score = {}
    for i, t, *_ in rows:
        own = [coder.library.encode(" " + w, add_special_tokens=False).ids for w in split[i, t][:-1]] + [[model.end]]
        ids = np.array([x for w in own for x in w])
        spelt = lm.by_word(ids, np.array([len(ids)]), np.array([len(own)]), model)
        score[i] = sum(math.log10(model.weight * count[w] / n + (1 - model.weight) * math.exp(x)) for w, x in zip(split[i, t], spelt, strict=True))
    assert all(abs(r.score - score[r.doc_id]) < 1e-4 * abs(score[r.doc_id]) for r in got)
    # words whose counts come by the join count as those that are broadcast
    rare = dataclasses.replace(model, words=model.words[::3], times=model.times[::3])
    again = {(r.doc_id, r.n_tokens): r for r in lm.scores(texts, (rare, counted, total), "<u2").collect()}
    assert all(abs(r.score - again[r.doc_id, r.n_tokens].score) < 1e-6 * abs(r.score) and r.n_known == again[r.doc_id, r.n_tokens].n_known for r in got)
    assert lm.learn_and_score(docs, F.lit(True), queries.vocabulary()).filter("train_tokens = 0 and n_known = 0").count() == len(rows)
    odd = spark.createDataFrame([(None, None, 1), (None, "a b", 2), (1, "a b", 3), (1, "a b", 3), (2, " " * 40, 4)], "doc_id long, text string, score int")
    assert sorted((r.n_tokens, r.score < 0) for r in lm.learn_and_score(odd, F.lit(False), queries.vocabulary()).collect()) == [(1, True), (1, True), (3, True), (3, True), (3, True)]


def small_model(size=40):
    rng = np.random.default_rng(0)
    c = lm.CLASSES
    pairs = np.log(rng.dirichlet(np.ones(c), c + 1))
    shape = {"E": (lm.ROWS + 1, lm.WIDTH), "Q": (lm.WIDTH, lm.WIDTH), "K": (lm.WIDTH, lm.WIDTH), "V": (lm.WIDTH, lm.WIDTH), "S": (lm.WIDTH, lm.WIDTH), "U": (lm.WIDTH, lm.TOPICS), "B": (lm.TOPICS,), "M": (c, lm.TOPICS), "R": (lm.WINDOW,)}
    leads = np.arange(size + 1) % 2 == 0
    return lm.Model(size, np.minimum(np.arange(size + 1), c - 1), np.zeros(size + 1), leads, pairs, {k: rng.normal(0, 0.5, s) for k, s in shape.items()}, np.zeros(0, np.uint64), np.zeros(0, np.int64))


def test_model_is_causal_and_sums_to_one():
    model = small_model()
    ids = np.random.default_rng(1).integers(0, 40, 90)
    logs = lambda ids, counts, model: lm.logs(ids, np.array(counts), model)[0]
    whole = logs(ids, [90], model)
    changed = ids.copy()
    changed[60:] = 7
    assert np.allclose(whole[:60], logs(changed, [90], model)[:60])
    assert np.allclose(np.concatenate([logs(ids[:33], [33], model), logs(ids[33:], [57], model)]), logs(ids, [33, 57], model))
    # over all classes: ids 0..CLASSES-1, each its own class
    model.class_of, model.inside, model.leads = np.arange(lm.CLASSES), np.zeros(lm.CLASSES), np.arange(lm.CLASSES) % 3 == 0
    ends = np.stack([np.append(ids[:5], k) for k in range(lm.CLASSES)])
    got, begins = lm.logs(ends.reshape(-1), np.full(lm.CLASSES, 6), model)
    last = got.reshape(-1, 6)[:, -1]
    assert abs(np.exp(last).sum() - 1) < 1e-3
    where = np.flatnonzero(model.leads[ends.reshape(-1)])
    assert np.allclose(np.exp(begins[where % 6 == 5]), np.exp(last[model.leads]).sum(), atol=1e-4)


@pytest.mark.parametrize("weight", [0.0, 0.5])
def test_words_sum_to_one(weight):
    """Over the end and all words of up to nine ids after a given text: ids 0 and 1 begin a word, 2 and 3 go on."""
    model = small_model(4)
    model.leads = np.array([True, True, False, False, True])
    model.pairs[:] = -60
    model.pairs[:, :5] = np.log(np.random.default_rng(3).dirichlet([4, 4, 1, 1, 4], lm.CLASSES + 1))
    words = [[a, *rest] for a in (0, 1) for k in range(9) for rest in itertools.product((2, 3), repeat=k)] + [[4]]
    texts = [[1, 2, 0, *w] + ([4] if w != [4] else []) for w in words]
    n = np.array([3 + (w != [4]) for w in words])
    spelt = lm.by_word(np.concatenate(texts), np.array([len(t) for t in texts]), n, model)
    third = np.cumsum(n) - n + 2
    share = np.array([0.25 if w in ([0], [1, 2], [4], [0, 3]) else 0.0 for w in words])
    total = np.exp(lm.mixed_log(spelt[third], share, weight) if weight else spelt[third]).sum()
    assert 0.99 < total < 1.0001


def test_gradient_is_the_slope():
    model = small_model()
    down = lm.Descent(model)
    rng = np.random.default_rng(2)
    shape = (3, lm.WINDOW)
    x, before, y, on = rng.integers(0, lm.ROWS + 1, shape), rng.integers(0, lm.CLASSES + 1, shape), rng.integers(0, lm.CLASSES, shape), rng.random(shape) < 0.8
    p = {k: v.astype(np.float64) for k, v in down.p.items()}

    def loss(p):
        q, k, v = (p["E"][x] @ p[n] for n in ("Q", "K", "V"))
        w = q @ k.transpose(0, 2, 1) / np.sqrt(lm.WIDTH) + p["R"][np.abs(lm._BEFORE)] + lm._CAUSAL
        w = np.exp(w - w.max(2, keepdims=True))
        h = np.tanh(w / w.sum(2, keepdims=True) @ v + p["E"][x] @ p["S"])
        z = np.exp(h @ p["U"] + p["B"])
        times = np.exp(p["M"])
        return -(np.log((z * times[y]).sum(2) / (z * (down.share.astype(float) @ times)[before]).sum(2)) * on).sum() / on.sum()

    times = np.exp(p["M"])
    got, own, shared_ = lm.gradient(p, times, down.share @ times, x, before, y, on)
    got["M"] = (own + down.share.T @ shared_) * times
    for name, v in p.items():
        at = tuple(np.array(np.unravel_index(np.abs(got[name]).argmax(), v.shape)))
        for where in (at, tuple(rng.integers(0, s) for s in v.shape)):
            up, low = ({**p, name: v.copy()} for _ in range(2))
            up[name][where] += 1e-5
            low[name][where] -= 1e-5
            assert abs((loss(up) - loss(low)) / 2e-5 - got[name][where]) < 1e-4


def test_training_takes_every_window_once():
    counts = np.array([3000, 5, 700])
    ids = np.random.default_rng(8).integers(0, 9, counts.sum())
    first, size, _ = lm.windows(counts)
    seen, taken = [], 0
    for last in (False, True):
        down = lm.Descent(small_model())
        down.step = lambda x, before, y, on: seen.append(on.sum())
        down.add(ids, counts, lambda i: i % lm.FIRST > 0 if last else i % lm.FIRST == 0)  # noqa: B023
        down.flush()
        taken = down.taken
    assert taken == len(first) and sum(seen) == size.sum()


def test_training_lowers_the_loss():
    model = small_model()
    ids = np.tile([1, 2, 3, 4, 9, 8, 7], 3000)
    before = lm.logs(ids, np.array([len(ids)]), model)[0].mean()
    down = lm.Descent(model)
    for _ in range(48):
        down.add(ids, np.array([len(ids)]), lambda i: i >= 0)
    down.flush()
    model.params = down.p
    assert down.t > 40 and lm.logs(ids, np.array([len(ids)]), model)[0].mean() > before + 0.2


def test_windows_score_each_id_once():
    counts = np.array([1, 31, 32, 33, 56, 57, 500])
    first, size, skip = lm.windows(counts)
    hit = np.zeros(counts.sum(), int)
    for f, n, k in zip(first, size, skip, strict=True):
        hit[f + k : f + n] += 1
    assert (hit == 1).all()


PAGE = '<html><head><title>t</title><script>x="</p>"</script></head><body class="x"><nav>Menu<li>a</nav><div class="{box}">Follow us today</div>{body}<footer>f</footer><form>q</form></body></html>'


def test_pages(spark):
    body = "<div class='story'><h2>Head &amp; {i}</h2><p>One  <b>two\n{i}</b><br>x<p>Last &lt;{i}&gt;</div>"
    pages = [(i, "http://a.org/%d" % i, PAGE.format(box="promo2x", body=body.format(i=i))) for i in range(12)]
    pages += [(20, "http://A.org/20", pages[0][2]), (21, "https://b.org", "<article><h1>T</h1><p>text<div class=comments>no</div><aside>no</aside><header>kept</header></article><p>no"), (22, None, None), (23, "x", ""), (24, "x", "plain &eacute; <"), (20, "http://A.org/20", pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("low", F.lit(1))
    got = Counter(tuple(r) for r in sitetree.extract(df).select("page_id", "text", "n_chars").collect())
    want = Counter()
    for i in [*range(12), 20, 20]:
        k = i if i < 12 else 0
        text = f"Head & {k}\nOne two {k} x\nLast <{k}>"
        want[i, text, len(text)] += 1
    for i, text in ((21, "T\ntext\nkept"), (22, ""), (23, ""), (24, "plain é <")):
        want[i, text, len(text)] += 1
    assert got == want and sitetree.extract(df.limit(0)).count() == 0


def test_style_tree_by_counting(spark):
    """Entropies, low branches and repeated texts anew, from the blocks of random pages of three hosts."""
    rnd = random.Random(3)
    line = lambda k: f"line {rnd.randrange(k)} says something"
    pages = []
    for i in range(90):
        parts = [f"<div class=a{j}>{''.join(f'<p>{line(k)}</p>' for _ in range(rnd.randint(1, 2)))}{'<p>Always here</p>' * (k == 30)}<ul>{'<li>x</li>' * rnd.randint(1, 2)}</ul></div>" for j, k in enumerate((1, 2, 30, 10**6))]
        pages.append((i, f"http://h{i % 3}.org/{i}", f"<body>{'<main>' if i % 3 else ''}{''.join(parts)}<p>Own {i}</p></body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))
    got = {tuple(r) for r in sitetree.judged(df).collect()}
    want = set()
    for host in ("h0.org", "h1.org", "h2.org"):
        values, inside, outside = defaultdict(Counter), defaultdict(Counter), Counter()
        for body in {tuple(map(tuple, sitetree.blocks(h)[0])): h for _, u, h in pages if u[7:13] == host}.values():
            texts, nodes, named = sitetree.blocks(body)
            by, layouts = defaultdict(list), defaultdict(list)
            for path, t, _ in texts:
                by[path].append(t)
            for path, c in nodes:
                layouts[path].append(c)
            for path, t in by.items():
                values[path, 0][sitetree._crc("\n".join(t))] += 1
                inside[path].update(set(map(sitetree._crc, t)) if len(t) > 1 else ())
            for path, c in layouts.items():
                values[path, 1][sitetree._crc(";".join(c))] += 1
            for path in {path for path, _, own in texts if named and not own}:
                outside[path] += 1
        importance, pages_of = {}, {}
        for (path, kind), seen in values.items():
            m = sum(seen.values())
            entropy = -sum(c / m * math.log(c / m, m) for c in seen.values()) if m > 1 else 1.0
            importance[path] = max(importance.get(path, 0.0), entropy)
            pages_of[path, kind] = m
        judged = {p: x for p, x in importance.items() if max(pages_of.get((p, 0), 0), pages_of.get((p, 1), 0)) >= sitetree.MIN_PAGES}
        branch = defaultdict(float)
        for path, x in judged.items():
            parts = path.split("/")
            for k in range(len(parts)):
                up = "/".join(parts[: k + 1])
                branch[up] = max(branch[up], x)
        want |= {(host, p, 0, 0) for p, x in branch.items() if x < sitetree.LOW}
        for path in judged:
            m = pages_of.get((path, 0), 0)
            if m >= sitetree.MIN_PAGES:
                want |= {(host, path, 1, v) for c in (values[path, 0], inside[path]) for v, k in c.items() if k >= 0.7 * m and k >= 0.7 * sitetree.MIN_PAGES}
                want |= {(host, path, 2, 0)} if outside[path] and importance[path] >= sitetree.HIGH else set()
    assert got == want and any(r[2] == 0 for r in got) and any(r[2] == 1 for r in got)


def test_pages_that_name_an_article(spark):
    """The tree weighs them too: a bare notice in main goes, main text beside a teaser stays."""
    html = "<body><main><div class=box><p>Read our <b>terms</b> today</p></div><p>Story {i} of the day</p><p>Repeated line</p></main></body>"
    teaser = "<body><article>See {j}</article><div class=story><p>Long main text number {i} of this page</p></div></body>"
    pages = [(i, "http://a.org/%d" % i, html.format(i=i)) for i in range(12)] + [(50 + i, "http://b.org/%d" % i, teaser.format(i=i, j="also")) for i in range(12)]
    pages += [(90, "http://c.org", teaser.format(i=1, j="2")), (91, "http://d.org", html.format(i=3))]
    pages += [(100 + i, "http://e.org/%d" % i, teaser.format(i=i, j=f"the longer teaser {i} " + "x" * 90)) for i in range(12)]
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    main = "Long main text number {} of this page"
    for i in range(12):
        assert got[i] == f"Story {i} of the day"
        assert got[50 + i] == main.format(i)
        assert got[100 + i] == f"See the longer teaser {i} " + "x" * 90 + "\n" + main.format(i)
    assert got[90] == "See 2\n" + main.format(1) and got[91] == "Read our terms today\nStory 3 of the day\nRepeated line"


def test_training_lays_out_few_windows_at_once():
    """Runs of a batch are bounded, and the descent's steps are those over the whole batch."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 400, 300)
    ids = [rng.integers(0, 50, n).astype("<u2").tobytes() for n in sizes]
    batch = pa.record_batch({"text": [""] * 300, "ids": pa.array(ids, pa.binary())})
    cut = list(lm.runs(iter([batch.slice(0, 0), batch.slice(1)]), 1, 2000))
    assert [x for b in cut for x in b.column(1).to_pylist()] == ids[1:] and len(cut) > 30
    assert all(b.num_rows == 1 or sum(map(len, b.column(1).to_pylist())) <= 2000 for b in cut)
    shape = {"E": (lm.ROWS + 1, lm.WIDTH), **{k: (lm.WIDTH, lm.WIDTH) for k in "QKVS"}, "R": (lm.WINDOW,), "U": (lm.WIDTH, lm.TOPICS), "B": (lm.TOPICS,), "M": (lm.CLASSES, lm.TOPICS)}
    params = {k: rng.normal(0, 0.3, x) for k, x in shape.items()}
    pairs = np.full((lm.CLASSES + 1, lm.CLASSES), -np.log(lm.CLASSES))
    model = lm.Model(50, np.arange(51), np.zeros(51), np.ones(51, bool), pairs, params, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    made = []
    for some in (lm.runs(iter([batch]), 1, 2000), [batch]):
        now = lm.Descent(model)
        for b in some:
            now.add(*lm._ids(b.column(1), "<u2"), lambda i: i % 3 > 0)
        now.flush()
        made.append(now.p)
    assert all(np.array_equal(made[0][k], made[1][k]) for k in params)


def test_compact_windows_by_definition():
    rng = np.random.default_rng(4)
    counts = np.array([0, 5, 60, 80])
    keys = rng.integers(0, 30, counts.sum()).astype(np.uint64)
    t, lo, c, hi = compact.windows(keys, counts, np.uint64(7), 10)
    rank = [(int(x), i) for i, x in enumerate(shared.mix(keys * np.uint64(7)) >> np.uint64(8) << np.uint64(8))]
    for begin, n in ((5, 60), (65, 80)):
        for a in range(begin, begin + n - 9):
            for b in (a + 10, begin + n):
                least = min(range(a, b), key=lambda i: rank[i])
                assert ((lo <= a) & (c == least) & (hi >= b)).any()


def test_substring_dedup(spark, docs, rows, nothing):
    own = defaultdict(set)
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 49):
            own[tuple(w[k : k + 50])].add((i, t))
    want = {i for s in own.values() if len({x for x in s}) > 1 for i, _ in s}
    found = compact.report(docs).collect()
    assert want <= {r.doc_id for r in found} and not {900, 901, 902, 903, 906} & {r.doc_id for r in found}
    for r in found:
        assert r.n_repeat_words == sum(b - a for a, b in r.spans) and all(b - a >= 50 for a, b in r.spans)
    assert compact.report(nothing).count() == 0


def test_substring_dedup_counts_every_copy(spark):
    """A passage that one text holds twice is two spans in it, whichever comes first; equal rows without a partner are whole."""
    word = iter(range(10**6))
    fresh = lambda n: [f"w{next(word)}" for _ in range(n)]
    docs, want = [], {}
    for i in range(0, 20, 2):
        shared_words = fresh(60)
        docs += [(i, " ".join(fresh(70) + shared_words + fresh(70))), (i + 1, " ".join(fresh(40) + shared_words + fresh(200) + shared_words + fresh(30)))]
        want |= {i: [(70, 130)], i + 1: [(40, 100), (300, 360)]}
    docs += [(50, " ".join(fresh(80)))] * 2 + [(51, " ".join(fresh(49)))] * 2
    found = compact.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append([tuple(s) for s in r.spans])
    assert got.pop(50) == [[(0, 80)]] * 2 and 51 not in got
    assert got and all(got[i] == [want[i]] for i in got) and any(i % 2 for i in got)


def similar(a, b):
    """Whether two word lists share a passage, by sets of their segments of 46 shingles on one diagonal and beyond."""
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    x, y = grams(a), grams(b)
    where = defaultdict(list)
    for j, g in enumerate(y):
        where[g].append(j)
    for i in range(len(x) - 45):
        for j in where.get(x[i], ()):
            for n in (46, 52, 60, 80):
                p, q = set(x[i : i + n]), set(y[j : j + n])
                if i + n <= len(x) and j + n <= len(y) and 5 * len(p & q) >= 4 * len(p | q):
                    return True
    return False


def test_near_passages_are_found(spark):
    """Recall over pairs that share an edited passage, a third of them with stock text in it; strangers share the stock alone."""
    rnd, word = random.Random(12), iter(range(10**7))
    fresh = lambda n: [f"w{next(word)}" for _ in range(n)]
    stock = [fresh(28) for _ in range(3)]
    docs, pairs = [], []
    for i in range(240):
        own = fresh(rnd.randint(54, 140))
        if i % 3 == 0:
            own = own[:10] + stock[i % 9 // 3] + own[10:42]
        other = list(own)
        for k in range(rnd.randint(20, 40), len(own), 60):
            other[k : k + 1] = [fresh(1), [], fresh(2)][rnd.randrange(3)]
        a, b = fresh(rnd.randint(0, 90)) + own + fresh(rnd.randint(0, 90)), fresh(rnd.randint(0, 90)) + other + fresh(rnd.randint(0, 90))
        pairs.append((2 * i, 2 * i + 1, similar(a, b)))
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    docs += [(1000 + i, " ".join(fresh(60) + stock[i % 3] + fresh(60))) for i in range(600)]
    got = {r.doc_id for r in compact.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()}
    true = [(a, b) for a, b, same in pairs if same]
    found = sum(a in got and b in got for a, b in true)
    assert len(true) > 150 and found >= 0.95 * len(true)
    assert not [i for i in got if i >= 1000]


def test_large_group_of_passages(spark):
    """A passage in two thirds of all texts is found in each, in one partition or many; entries of its group are few."""
    rnd = random.Random(5)
    passage = [f"p{k}" for k in range(70)]
    texts = [(i, " ".join([f"a{i}_{k}" for k in range(rnd.randint(0, 60))] + passage * (i % 3 > 0) + [f"b{i}_{k}" for k in range(60)])) for i in range(600)]
    for parts in (1, 9):
        found = compact.report(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)).collect()
        assert sorted(r.doc_id for r in found) == [i for i in range(600) if i % 3] and all(r.n_repeat_words == 70 for r in found)


def test_passages_odd_input(spark):
    same = " ".join(f"q{k}" for k in range(64))
    rows = [(None, same, 1), (None, same + " x", 2), (7, same, 3), (7, None, 4), (8, "", 5), (9, "q1 q2", 6), (7, "z " * 5000, 7)]
    got = compact.report(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()
    assert sorted((str(r.doc_id), r.n_repeat_words) for r in got if r.n_repeat_words < 100) == [("7", 64), ("None", 64), ("None", 64)]


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_paired_over_batches(size):
    rng = np.random.default_rng(size)
    rows = sorted((int(k), int(r)) for k, r in rng.integers(0, 40, (300, 2)))
    key, row = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    batches = [pa.record_batch({"key": key[i : i + size], "row": row[i : i + size], "room": np.full(len(key[i : i + size]), 46 << 8, np.int16)}) for i in range(0, len(key), size)]
    got = {tuple(sorted(p)) for b in compact.paired(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    want = set()
    for k in range(40):
        own = row[key == k].tolist()
        want |= {tuple(sorted((x, y))) for i, x in enumerate(own) for y in own[:i] if x != y}
    assert got == want


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_all_windows_with_room_are_paired(size):
    """Also those that have room for a passage with neither the first of their group nor the one before; large groups go on."""
    key, row = np.array([1, 1, 1, 1, 2, 2, 3, 3, 3, 3, 3, 4, 4]), np.array([5, 6, 7, 8, 5, 6, 1, 2, 3, 4, 5, 1, 1])
    room = np.array([46 << 8, 23 << 8 | 23, 46, 23 << 8 | 23, 46, 46, *[46] * 5, 46, 46], np.int16)
    batches = [pa.record_batch({"key": key[i : i + size], "node": row[i : i + size], "room": room[i : i + size]}) for i in range(0, len(key), size)]
    got = [r for b in compact.parted(iter(batches), 4) for r in b.to_pylist()]
    assert sorted((r["a"], r["b"]) for r in got if r["key"] is None) == [(5, 6), (6, 8)]
    assert [(r["key"], r["a"], r["room"]) for r in got if r["key"] is not None] == [(3, i, 46) for i in range(1, 6)]


def test_windows_of_a_large_group_are_paired_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(compact, "MOST", 7)
    windows = [(9, i, None, [46 << 8, 46, 23 << 8 | 23][i % 3]) for i in range(60)]
    tiles = compact._tiles(spark.createDataFrame(windows + [(None, 1, 2, None)], "key long, a long, b long, room short"))
    got = [tuple(r) for r in shared.arrow(tiles, compact.paired, "a long, b long").collect()]
    assert sorted(got) == [(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 == j % 3]
    assert tiles.groupBy("key").count().agg({"count": "max"}).first()[0] < 40


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_lists_of_several_over_batches(size):
    rng = np.random.default_rng(size)
    rows = sorted((int(k), int(s)) for k, s in rng.integers(0, 60, (150, 2)))
    key, sig = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    part = lambda c, i: pa.array(c[i : i + size])
    batches = [pa.record_batch([part(key, i), part(sig, i), part(sig.astype(np.int32), i), part(key.astype(np.int32), i)], toccurrence._ENTRY) for i in range(0, len(key), size)]
    got = sorted((r["key"], r["sig"], r["n"], r["pos"], r["hub"]["sig"]) for b in toccurrence.several(iter(batches)) for r in b.to_pylist())
    sets_of = {k: sorted(set(sig[key == k].tolist())) for k in set(key.tolist())}
    assert got == sorted((k, s, s, k, own[0]) for k, own in sets_of.items() if len(own) > 1 for s in own)


def test_passages_with_edits():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**60, 200).astype(np.uint64), rng.integers(0, 2**60, 150).astype(np.uint64)
    b[20:90] = a[100:170]
    b[50] = 1
    ((lo, hi, x, y),) = compact.passages(a, b)
    assert (lo, hi, x, y) == (100, 170, 20, 90) and compact.passages(a, a[:40]) == [] and compact.passages(a, a[:0]) == []


def test_chat(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "b ####"), (1, 0, "user", None), (1, 0, "user", "tie"), (2, 0, "system", hard), (2, 1, "assistant", hard), (2, 2, "assistant", "<\\/turn>:"), (3, None, "odd: role", ""), (None, 0, None, "x"), (2, 2, "assistant", "<\\/turn>:")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("x")).withColumn("json", F.lit("x"))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(chat.canonical(chat.messages(df)))).collect()}
    for key in (1, 2, 3, None):
        own = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == key])
        loss = "".join(x for _, r, x in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        written = "".join(chat.format_turn(r, x)[0] for _, r, x in own)
        assert chat.parse(written) == [(r, x) for _, r, x in own]
        assert tuple(got[key])[1:] == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss), len(written))


@pytest.mark.parametrize(
    ("record", "want"),
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "x", "output": None}, [("user", "i\n\nx"), ("assistant", "")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"what": 1}, None),
        ({}, None),
    ],
)
def test_layouts(record, want):
    assert chat.turns(record)[1] == want


def test_mixing(spark, docs, nothing):
    rnd = random.Random(2)
    vocab, bad = [f"w{i}" for i in range(80)], ["vile", "scum", "fool"]
    texts = [" ".join([rnd.choice(vocab) for _ in range(60)] + ([rnd.choice(bad) for _ in range(6)] if i % 4 == 0 else [])) for i in range(400)]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string").withColumn("p", F.lit(1))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    domain = F.expr(queries.DOMAIN)
    got = {r.doc_id: r for r in mixing.report(made, labels, domain, {"clean": 0.9, "toxic": 0.1}).collect()}
    tokens = sum(r.n_tokens for r in got.values())
    for d, share in (("clean", 0.9), ("toxic", 0.1)):
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got.values()) - share * tokens) < 0.01 * tokens
    assert all(r.rate >= 0 and (r.p_toxic > 0.5) == (i % 4 == 0) for i, r in got.items() if i < 400) and got[900].n_tokens == 0
    kept = mixing.mix(made, labels, domain, {"clean": 1.0, "toxic": 0.0}, keep_total=False, rounding="nearest")
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(400) if i % 4} and kept.columns == made.columns
    assert not {r.doc_id for r in kept.collect()} & set(range(0, 400, 4))
    assert mixing.report(nothing, labels, domain, {"clean": 1.0}).count() == 0
    assert {r.rate for r in mixing.report(made, labels.limit(0), domain, {"clean": 0.5, "toxic": 0.5}).collect()} == {1.0}


def test_mixing_is_projected_gradient(spark, docs):
    """The rates anew: projected gradient on all rates at once, with the model's own steps; and the residual it reports."""
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    domain, weights = F.expr(queries.DOMAIN), {"clean": 0.7, "toxic": 0.3}
    model = mixing.learn(docs, labels, domain, list(weights))
    members = mixing.posteriors(docs, model)
    mixing.fit(members, model, weights)
    rows = members.collect()
    n, p = np.array([r.n_tokens for r in rows], float), np.array([r.p for r in rows])
    r, last = np.ones(len(rows)), np.ones(len(rows))
    for step, momentum in model.steps:
        ahead = r + momentum * (r - last)
        last, r = r, np.maximum(0, ahead - p @ step)
        assert np.allclose(step.shape, 2)
    assert np.allclose(r, model.rates(p)) and (r >= 0).all()
    target = np.array([0.7, 0.3]) * n.sum()
    assert np.allclose((r * n @ p - target) / target, [model.residual[d] for d in weights], atol=1e-6)
    first = ((n @ p) - target) / (n @ p)
    assert np.allclose(model.steps[0][0], first)


def test_mixing_of_a_rare_domain(spark):
    """0.08 % of the tokens are toxic: the first step is taken all the same, for shares of its own and of all."""
    model = lambda: mixing.Model(["clean", "toxic"], np.zeros(1, np.uint64), np.ones((7, 2)), np.ones(5))
    p = [(100, [0.02, 0.98])] * 4 + [(100, [1.0, 0.0])] * 4996
    members = spark.createDataFrame(p, "n_tokens long, p array<double>")
    for keep_total in (False, True):
        made = model()
        mixing.fit(members, made, {"clean": 1.0, "toxic": 0.0}, keep_total)
        clean, toxic = made.rates(np.array([[1.0, 0.0], [0.02, 0.98]]))
        assert toxic < 0.03 and abs(clean - 1) < 0.01


def test_mixing_goes_on_to_its_targets(spark):
    """Posteriors that overlap: the target of 0 is met to 7 % of the domain (27 % after 20 plain steps), and the rest is told."""
    rng = np.random.default_rng(1)
    z = np.where(np.arange(3000) < 150, 4.0, -3.0) + 1.5 * rng.normal(size=3000)
    p = np.stack([1 / (1 + np.exp(z)), 1 / (1 + np.exp(-z))], 1)
    members = spark.createDataFrame([(100, x) for x in p.tolist()], "n_tokens long, p array<double>")
    model = mixing.Model(["clean", "toxic"], np.zeros(1, np.uint64), np.ones((7, 2)), np.ones(5))
    with pytest.warns(UserWarning, match="off its targets"):
        mixing.fit(members, model, {"clean": 1.0, "toxic": 0.0})
    left = (model.rates(p) @ p)[1] / p[:, 1].sum()
    assert abs(left - model.residual["toxic"]) < 1e-9 and left < 0.1


def test_sweep(spark):
    made = shared.written(spark.range(3))
    path = made.inputFiles()[0]
    shared.sweep(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_cascade_order_is_greedy():
    """A rule that rejects what another has already rejected comes late, however cheap."""
    rejects = {"a": np.array([1, 1, 1, 0, 0, 0], bool), "b": np.array([1, 1, 0, 0, 0, 0], bool), "c": np.array([0, 0, 0, 1, 0, 0], bool)}
    assert quality.greedy(rejects, {"a": 1.0, "b": 0.9, "c": 1.0}) == ["a", "c", "b"]
    assert quality.greedy(rejects, {"a": 9.0, "b": 0.9, "c": 1.0})[0] == "b"


def test_chat_layouts_meet_in_one_table(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"{i} ### x\\ {t}") for i in range(40) for t in range(3)] + [(41, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.canonical(chat.messages(df)).collect()
    assert len({r.fingerprint for r in made}) == 4 and all(r.fingerprint in chat.MAPPINGS for r in made)
    assert sorted((r.id, r.pos, r.role, r.text) for r in made) == sorted((i, t, r or "", x or "") for i, t, r, x in rows)


def test_token_ids_known_parts_are_not_put_in_again():
    """A part that the younger generation has stays; one that only the older has comes over, and a new one is made."""

    class Counted(dict):
        def update(self, items):
            items = list(items)
            self.came = [p for p, _ in items]
            super().update(items)

    coder = idcodec.Encoder(queries.vocabulary())
    first = coder.learn([b" one", b" two"])
    coder.old, coder.parts = {b" three": coder.learn([b" three"])[0]}, Counted({b" one": first[0]})
    assert coder.learn([b" one", b" two", b" three"]) == [*first, coder.old[b" three"]]
    assert coder.parts.came == [b" two", b" three"]


def test_all_training_words_vote_on_the_weight(spark):
    """Three rows, none of which a draw of one row in 16 need hit, and words that are rare: the likeliest weight of all tried."""
    held = F.col("doc_id") == 2
    said = ["alpha zyxgrub beta zyxgrub alpha " * 6, "zyxgrub alpha once", "unseen alpha", None]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    texts, tokens = lm.tokenised(docs, held, queries.vocabulary())
    fitted = lm.fit(texts, tokens, queries.vocabulary())
    few = dataclasses.replace(fitted[0], words=fitted[0].words[:1], times=fitted[0].times[:1])
    coder = idcodec.Encoder(queries.vocabulary())
    count = Counter(w for i, t in enumerate(said) if i != 2 for w in [*(t or "").split(), None])
    total = sum(count.values())
    votes = np.zeros(len(lm.WEIGHTS))
    for i, t in enumerate(said):
        if i != 2:
            split = [*(t or "").split(), None]
            own = [coder.library.encode(" " + w, add_special_tokens=False).ids for w in split[:-1]] + [[fitted[0].end]]
            ids = np.array([x for w in own for x in w])
            spelt = lm.by_word(ids, np.array([len(ids)]), np.array([len(own)]), fitted[0])
            share = np.array([(count[w] - 1) / total for w in split])
            votes += [lm.mixed_log(spelt, share, w).sum() for w in lm.WEIGHTS]
    rows = lm.scores(texts, fitted, "<u2").collect()
    assert fitted[0].weight == lm.WEIGHTS[votes.argmax()] > lm.WEIGHTS[0]
    # the same where most counts come by the join
    again = {r.doc_id: r.score for r in lm.scores(texts, (few, *fitted[1:]), "<u2").collect()}
    assert few.weight == fitted[0].weight and all(abs(r.score - again[r.doc_id]) < 1e-6 for r in rows)


def test_near_copies_are_sent_by_blocks_not_by_pairs(spark, monkeypatch):
    """300 texts that are all candidates of each other: each goes where two blocks meet, and every pair is verified in one place."""
    monkeypatch.setattr(compact, "BLOCK", 64)
    pairs = [(a, b) for a in range(300) for b in range(a + 1, 300)] + [(500, 501)]
    candidates = spark.createDataFrame(pairs, "a long, b long")
    nodes = [*range(300), 500, 501]
    small, large = (spark.createDataFrame([(n, size) for n in nodes], "node long, size long") for size in (2_000, compact.BYTES // 30))
    for sizes, most in ((small, 8), (large, 20)):
        got = compact.meetings(candidates, compact.blocks(candidates, sizes)).collect()
        assert sorted((r.node, b) for r in got for b in r.others) == pairs
        assert all({b for r in got if r.tile == t for b in r.others} <= {r.node for r in got if r.tile == t} for t in {r.tile for r in got})
        assert len(got) < 302 * most  # some 45,000 where each partner is sent its own
    tiles = Counter(r.tile for r in compact.meetings(candidates, compact.blocks(candidates, large)).collect())
    assert max(tiles.values()) < 120
