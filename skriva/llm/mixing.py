"""Mixing sources to target weights by soft membership.

A softmax regression, trained in numpy on a bounded sample of labelled rows, gives each document its
posterior over the domains. Documents get nonnegative rates r whose expected domain totals,
sum of r * tokens * posterior, match targets: least squares by projected gradient with momentum, where a step
needs only the D totals of the last two. A document's rate depends on its own posterior and the D numbers of
each step so far, so a step is one aggregation and nothing but those numbers is kept between steps. A descent
that ends off its targets says so, by domain, in a warning.

Null text has no tokens and the posterior of an empty text. Rows with null labels aren't learnt from. Without
labelled rows every rate is 1. Equal rows get equal rates; a document with several labels is learnt from once
(the first by domain). Texts of any length are read whole. Other columns of docs come back as they are.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import shared
from .quality import measures

#: Labelled rows to learn from (lowest hashes of the id), words kept for each domain, least documents of a word.
SAMPLE, WORDS, LEAST = 4096, 192, 4
#: Steps at most, the relative distance from the targets that ends them, and the steps in which the squared
#: distance has to fall by STILL of itself.
STEPS, CLOSE, PATIENCE, STILL = 100, 1e-3, 10, 1e-4
#: Steps at most towards shares of each domain's own tokens: further ones only trade documents of small posteriors.
OWN_STEPS = 20
_DENSE = 5


@dataclass
class Model:
    domains: list[str]
    words: np.ndarray  # sorted hashes
    weight: np.ndarray  # a row for each word, then the dense features and the constant
    scale: np.ndarray
    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)  # gradient and momentum
    residual: dict[str, float] = field(default_factory=dict)  # by domain, where the fit ended: distance from the target, relative

    def posteriors(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posterior over the domains) of each text."""
        n, which, row, dense = features(buf, off, self.words)
        z = np.hstack([dense / self.scale, np.ones((len(n), 1))]) @ self.weight[len(self.words) :]
        np.add.at(z, row, self.weight[which])
        z = np.exp(z - z.max(1, keepdims=True))
        return n, z / z.sum(1, keepdims=True)

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = last = np.ones(len(p))
        for g, momentum in self.steps:
            last, r = r, np.maximum(0, r + momentum * (r - last) - p @ g)
        return r


def features(buf: np.ndarray, off: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, known words and the rows that hold them, dense features)."""
    starts, ends, n = shared.spans(buf, off)
    key = shared.hashes(buf, starts, _bare(buf, starts, ends), shared.LOWER)
    at = np.minimum(np.searchsorted(words, key), max(len(words) - 1, 0))
    hit = np.flatnonzero(words[at] == key) if len(words) else np.zeros(0, np.int64)
    pair = np.unique(np.repeat(np.arange(len(n)), n)[hit] * max(len(words), 1) + at[hit])
    m = measures(buf, off)
    share = lambda k: m[k] / np.maximum(m["n_words"], 1)
    dense = np.stack([np.minimum(share("n_symbols"), 1), share("n_repeat_words"), m["n_dup_lines"] / np.maximum(m["n_lines"], 1), np.log1p(n) / 10, np.minimum(share("word_chars"), 50) / 50], 1)
    return n, pair % max(len(words), 1), pair // max(len(words), 1), dense


def _bare(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of words without one mark after them."""
    mark = np.isin(buf[ends - 1], np.frombuffer(b",.;:!?", np.uint8)) if len(ends) else np.zeros(0, bool)
    return np.where(mark & (ends - starts > 1), ends - 1, ends)


def learn(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], sample: int = SAMPLE) -> Model:
    """A classifier of the domains; domain is an expression over labels."""
    picked = labels.select("doc_id", domain.alias("domain")).filter("domain is not null and doc_id is not null")
    picked = picked.orderBy(F.xxhash64("doc_id"), "domain").limit(sample).dropDuplicates(["doc_id"])

    def own(batches):
        for rows, buf, off in shared.pieces(batches):
            starts, ends, n = shared.spans(buf, off)
            key = shared.hashes(buf, starts, _bare(buf, starts, ends), shared.LOWER)
            words = [np.unique(k).view(np.int64) for k in np.split(key, np.cumsum(n)[:-1])]
            dense = features(buf, off, np.zeros(0, np.uint64))[3]
            yield shared.as_batch(["domain", "words", "dense"], [rows.column(0), words, list(dense)], [pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64())])

    # at most `sample` short rows: small enough to broadcast and to collect
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("domain", "text")
    got = shared.arrow(labelled, own, "domain string, words array<long>, dense array<double>").toArrow()
    if not got.num_rows:
        return Model(domains, np.zeros(0, np.uint64), np.zeros((_DENSE + 1, len(domains))), np.ones(_DENSE))
    index = {d: i for i, d in enumerate(domains)}
    y = np.array([index[d] for d in got.column(0).to_pylist()])
    rows = [np.array(w, np.int64).view(np.uint64) for w in got.column(1).to_pylist()]
    dense = np.array(got.column(2).to_pylist())
    every, at = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    df = np.stack([np.bincount(at[y[row] == d], minlength=len(every)) for d in range(len(domains))], 1)
    size = np.bincount(y, minlength=len(domains))
    total = df.sum(1)
    keep: set[int] = set()
    for d in range(len(domains)):
        if 0 < size[d] < len(y):
            rest = len(y) - size[d]
            p = total / len(y)
            z = (df[:, d] / size[d] - (total - df[:, d]) / rest) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / size[d] + 1 / rest))
            z[total < LEAST] = 0
            top = np.argsort(-z, kind="stable")[:WORDS]
            keep.update(top[z[top] > 5].tolist())
    words = np.array(sorted(keep), np.int64)
    place = np.full(len(every), -1)
    place[words] = np.arange(len(words))
    x = np.zeros((len(y), len(words) + _DENSE + 1))
    hit = place[at] >= 0
    x[row[hit], place[at][hit]] = 1
    scale = np.maximum(dense.std(0), 1e-3)
    x[:, len(words) : -1], x[:, -1] = dense / scale, 1
    return Model(domains, every[words], _softmax(x, y, len(domains)), scale)


def _softmax(x: np.ndarray, y: np.ndarray, k: int, steps: int = 400) -> np.ndarray:
    w, m, v = np.zeros((x.shape[1], k)), np.zeros((x.shape[1], k)), np.zeros((x.shape[1], k))
    goal = np.eye(k)[y]
    for t in range(1, steps + 1):
        z = x @ w
        z = np.exp(z - z.max(1, keepdims=True))
        g = x.T @ (z / z.sum(1, keepdims=True) - goal) / len(y) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens and p of each row, as a table: what the steps read instead of the texts."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for own, buf, off in shared.pieces(batches):
            n, p = known.value.posteriors(buf, off)
            yield shared.as_batch(["doc_id", "n_tokens", "p"], [own.column(0), n, list(p)], [pa.int64(), pa.int64(), pa.list_(pa.float64())])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shared.written(shared.arrow(picked, rows, "doc_id long, n_tokens long, p array<double>"))


def fit(members: DataFrame, model: Model, weights: dict[str, float], keep_total: bool = True) -> None:
    """Finds the rates, as model.steps. weights: each domain's share of all tokens, or (not keep_total) of its own."""
    d = len(model.domains)

    def totals():
        def rows(batches):
            own = np.zeros(d)
            for b in batches:
                p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                own += (np.asarray(b.column(0)) * model.rates(p)) @ p
            yield shared.as_batch(["p"], [[own]], [pa.list_(pa.float64())])

        made = shared.arrow(members.select("n_tokens", "p"), rows, "p array<double>").select(*[F.col("p")[i].alias(f"p{i}") for i in range(d)])
        return np.array([x or 0.0 for x in made.agg(*[F.sum(c).alias(c) for c in made.columns]).first()])

    mass = totals()
    if not mass.sum() or not len(model.words) and not model.weight.any():
        return
    share = np.array([weights.get(x, 0.0) for x in model.domains])
    target = share * mass.sum() / share.sum() if keep_total else share * mass
    # a domain is measured by its own target, or its own tokens if it is to have none
    scale = np.where(target > 0, target, np.maximum(mass, 1e-9))
    now, last, t, past, ends = mass, mass, 1.0, [], []
    most = STEPS if keep_total else OWN_STEPS
    for _ in range(most):
        turn = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / turn if keep_total else 0.0
        at, t = now + momentum * (now - last), turn
        model.steps.append(((at - target) / np.maximum(mass, 1e-9), momentum))
        last, now = now, totals()
        off = np.abs(now - target)
        past.append((off**2 / np.maximum(mass, 1e-9)).sum())
        ends.append(now)
        if (off <= CLOSE * scale).all() or not keep_total and off.max() < CLOSE * mass.sum():
            break
        if len(past) > PATIENCE and min(past[-PATIENCE:]) > (1 - STILL) * min(past[:-PATIENCE]):
            break
        if len(past) > 1 and past[-1] > past[-2]:
            t = 1.0
    # what came after the best step only led away from the targets
    best = int(np.argmin(past))
    del model.steps[best + 1 :]
    now, off = ends[best], np.abs(ends[best] - target)
    model.residual = dict(zip(model.domains, ((now - target) / scale).tolist(), strict=True))
    if (off > CLOSE * scale).any():
        warnings.warn(f"mixing ended off its targets after {len(past)} steps, relative to each domain: {model.residual}", stacklevel=2)


def copies(rate: Column, key: Column, rounding: str = "random") -> Column:
    """How often a document goes into the mix: its rate, rounded by a hash of the key, or to the nearest."""
    if rounding == "nearest":
        return F.floor(rate + 0.5)
    return F.floor(rate + F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30))


def report(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, the posteriors as p_<domain>, rate and copies of every row of docs."""
    model = learn(docs, labels, domain, list(weights))
    members = posteriors(docs, model)
    fit(members, model, weights)

    def rows(batches):
        for b in batches:
            p = np.array(b.column(2).to_pylist()).reshape(-1, len(model.domains))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.rates(p))], ["doc_id", "n_tokens", "p", "rate"])

    rated = shared.arrow(members, rows, "doc_id long, n_tokens long, p array<double>, rate double")
    own = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rated.select("doc_id", "n_tokens", *own, "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], keep_total: bool = True, rounding: str = "random") -> DataFrame:
    """The rows of docs, each as often as its rate says; all their columns."""
    model = learn(docs, labels, domain, list(weights))
    fit(posteriors(docs, model), model, weights, keep_total)
    known = docs.sparkSession.sparkContext.broadcast(model)
    columns, name = docs.columns, "text" if dict(docs.dtypes)["text"] == "string" else "__text"
    picked = docs if name == "text" else docs.select("*", F.col("text").cast("string").alias(name))

    def rows(batches):
        for own, buf, off in shared.pieces(batches, name):
            p = known.value.posteriors(buf, off)[1]
            yield pa.RecordBatch.from_arrays([*own.select(columns).columns, pa.array(known.value.rates(p))], [*columns, "__rate"])

    rated = shared.arrow(picked, rows, StructType([*docs.schema.fields, StructField("__rate", DoubleType())]))
    times = copies(F.col("__rate"), F.col("doc_id"), rounding)
    return rated.withColumn("__n", times).filter("__n > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).select(*columns)

