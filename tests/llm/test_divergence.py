"""The source divergence audit against a brute-force version."""

import random
import re
from collections import Counter, defaultdict

import pytest

from skriva.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, value string, rank string, term string, n string"


def by_hand(rows, least, told):
    docs, counts, in_docs = defaultdict(list), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall((text or "").translate(LOW))
        docs[lang or ""].append(source or "")
        counts[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    out = []
    for lang, sources in docs.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in set(sources)}
        share = lambda n, all_n: 1 + 10**9 * (n + 5) // (all_n + 5 * len(kept))
        every = {t: sum(counts[lang, s][t] for s in total) for t in kept}
        for s in total:
            far = [(sum(abs(share(counts[lang, s][t], total[s]) - share(counts[lang, o][t], total[o])) for t in kept), o) for o in total if o != s]
            above = [(share(counts[lang, s][t], total[s]) - share(every[t], sum(every.values())), t) for t in kept if counts[lang, s][t]]
            for part, found in (("pair", far), ("term", [x for x in above if x[0] > 0])):
                best = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(best) if part == "pair" or i < told]
    return sorted(out)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(["ba", "Ti", "so", "ré", "É", "no", "ﬀ"]) for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    rows = []
    for i in range(n):
        source = rnd.choice(["a", "a", "a", "b", "c", "d", None, "é", "z"])
        words = vocab[:50] if source != "b" else vocab[30:]
        rows.append((i, rnd.choice([" ", "1", "\n-"]).join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 20, 200]))), rnd.choice(["en", "fr", None]), source, "v", "r", "t", "n"))
    rows += [(500, None, "en", "empty", *"vrtn"), (501, "12 34", "en", "letterless", *"vrtn"), (502, "alone", "de", "a", *"vrtn"), (503, None, "de", "b", *"vrtn"), (None, rows[3][1], "en", "a", *"vrtn"), (3, rows[3][1], "en", "a", *"vrtn")]
    return rows + [(600, " ".join(vocab) * 300, "fr", "long", *"vrtn")]


@pytest.mark.parametrize(("seed", "least", "told"), [(1, 1, 50), (2, 4, 5), (3, 30, 50), (4, 10_000, 50)])
def test_report(spark, seed, least, told):
    rows = corpus(seed)
    got = divergence.report(spark.createDataFrame(rows, SCHEMA).repartition(5), least, told)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == by_hand(rows, least, told)


def test_small_buffers_give_the_same(spark, monkeypatch):
    """Sums and counts that are sent on early, and a term's postings over several batches."""
    rows = corpus(5)
    want = by_hand(rows, 2, 50)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(divergence, "HELD", 7)
    monkeypatch.setattr(divergence, "SUMS", 3)
    monkeypatch.setattr(divergence.shared, "PIECE", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, divergence.report(spark.createDataFrame(rows, SCHEMA).repartition(3), 2).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_nothing(spark):
    assert divergence.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_of_large_counts(spark):
    from pyspark.sql import functions as F

    n, total, kept = 40_000_000_000_000, 900_000_000_000_000, 70_000_000
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).head().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_the_index_is_not_broadcast(spark):
    """Its files are small for its rows, so Spark would send it to the driver instead of the groups."""
    plan = divergence.report(spark.createDataFrame(corpus(6), SCHEMA), 1)._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if re.search(r"Join \[lang#\d+, source#\d+\], \[lang#\d+, source#\d+\], Inner", x)]
    assert joins and not any("BuildLeft" in x for x in joins)
