"""Language-model scoring with a causal self-attention model over subword ids, trained in numpy.

A text is its words (runs without ASCII white space, A-Z lower-cased) and an end; a word is the subword ids
of " " + word in a public vocabulary. The ids that are commonest in all training rows are classes of their
own, all others share one, in which an id has its smoothed corpus share. A class's weight is its share after
the class before it, counted over all training rows, times a mix of TOPICS learnt weights; what one causal
attention head reads from the ids of the window sets the mix. Its sum over classes is a product with a small
table, so no softmax over classes is needed. Windows of WINDOW ids overlap by OVERLAP; each id is scored
once, in the first window that gives it that much context.

Every training row trains the head, with all its windows: each partition descends
over its own and the partitions' weights are averaged, in ROUNDS passes (the first over one window
in FIRST, the last over all others). A word's probability is a mix of its share of the training words and of the probability of
its ids: that of its first among the ids that begin a word, those of the others, and that of a word's
beginning (or the end) after them. Both sum to at most one over all words and the end, and so does the score
over all texts. The weight of the mix is the one of WEIGHTS under which all words of all training rows are likeliest,
each word left out of its own count: scoring tries them all at once.

Word counts are exact at any size: the HEAD commonest words are broadcast, the others joined by hash; both
count alike. The texts are tokenised once. Null text is empty: its end alone is scored. Equal rows get equal
scores; doc_id may be null, repeated or tied, columns of docs other than doc_id and text aren't read. A
text of any length passes in windows. No training rows: uniform counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .idcodec import Encoder, coder_of, forget

CLASSES, WIDTH, ROWS, TOPICS = 1024, 8, 1280, 8
WINDOW, OVERLAP = 32, 4
#: Passes of training, windows of which the first pass takes one, windows in a step, steps of the head to one of the topics' weights (whose sums over classes are the dear part).
ROUNDS, FIRST, BATCH, EVERY = 2, 8, 64, 8
#: Adam's step for the topics' weights and for the others; it falls with the steps of a partition.
RATES, RATE = {"M": 0.03}, 0.01
#: The weights of the mix that are tried.
WEIGHTS = np.array([0.001, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995])
#: Words, at most, whose counts are broadcast (16 bytes each).
HEAD = 1 << 19
#: Bytes of ids whose windows a task lays out at once; training takes some 100 bytes for each of them.
IDS = 1 << 17
#: Distinct words that a task holds before it sends their counts on.
MOST_HELD = 1 << 20
WORD, PAIR, TEXTS = 0, 1, 2


def spaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets by text, offsets by word) of the lower-cased words, each after one space."""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    out = np.append(np.uint8(32), shared.LOWER[buf])[np.repeat(starts - at, size) + np.arange(size.sum())]
    out[at] = 32
    by_word = np.append(at, len(out))
    return out, by_word[np.append(0, np.cumsum(n))], by_word


def subwords(coder: Encoder, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the words of all texts, an end after each text; ids by text; ids by word or end)."""
    own, _, by_word = spaced(buf, starts, ends, n)
    ids, sizes = coder.texts(own, by_word)
    by_text = shared.row_sums(sizes, n)
    return np.insert(ids, np.cumsum(by_text), end), by_text + 1, np.insert(sizes, np.cumsum(n), 1)


@dataclass
class Model:
    end: int
    class_of: np.ndarray  # by id; the class of what has none is CLASSES - 1
    inside: np.ndarray  # by id: log share in its class
    leads: np.ndarray  # by id: whether it begins a word or ends the text
    pairs: np.ndarray  # log share of a class after a class; the last row is the beginning
    params: dict[str, np.ndarray]
    words: np.ndarray  # sorted hashes of the commonest words
    times: np.ndarray  # and their counts
    weight: float | None = None  # of the mix; None until scores() has fitted it

    def count(self, key: np.ndarray) -> np.ndarray:
        """The words' counts, -1 for those that aren't among the commonest."""
        if not len(self.words):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
        return np.where(self.words[at] == key, self.times[at], -1)

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """The embedding row of each id."""
        c = self.class_of[ids]
        return np.where(c < CLASSES - 1, c, CLASSES + ids % (ROWS - CLASSES))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position, positions, positions not scored) of each window over texts of so many ids, laid end to end."""
    step = WINDOW - OVERLAP
    n = 1 + np.maximum(0, -(-(counts - WINDOW) // step))
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(counts) - counts)[text] + k * step
    return first, np.minimum(WINDOW, counts[text] - k * step), np.where(k > 0, OVERLAP, 0)


def context(ids: np.ndarray, counts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(embedding row, class) of what stands before each id; the beginning has the last of each."""
    rows, cls = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    rows[1:], cls[1:] = model.inputs(ids[:-1]), model.class_of[ids[:-1]]
    start = np.cumsum(counts) - counts
    rows[start], cls[start] = ROWS, CLASSES
    return rows, cls


_BEFORE = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
_CAUSAL = np.where(_BEFORE >= 0, 0, -1e9).astype(np.float32)


def tables(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the topics: the classes' weights, their sums after a class, and the sums over ids that begin a word."""
    times, share = np.exp(model.params["M"]), np.exp(model.pairs)
    rest = (model.class_of == CLASSES - 1) & model.leads
    begins = np.zeros(CLASSES)
    own = np.flatnonzero((model.class_of < CLASSES - 1) & model.leads)
    begins[model.class_of[own]] = 1
    begins[CLASSES - 1] = np.exp(model.inside[rest]).sum()
    return times.astype(np.float32), (share @ times).astype(np.float32), ((share * begins) @ times).astype(np.float32)


def logs(ids: np.ndarray, counts: np.ndarray, model: Model, batch: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each id after those before it in its text, and, for ids that begin a word, that of any such id."""
    rows, cls = context(ids, counts, model)
    goal, p = model.class_of[ids], model.params
    q, k, v, s = (p["E"] @ p[x] for x in ("Q", "K", "V", "S"))
    # one row for each input; the bounds keep exp() in range and are far beyond what is learnt, the ones sum the weights
    most = 2.7
    table = np.concatenate([np.clip(q / np.sqrt(WIDTH), -most, most), np.clip(k, -most, most), v, np.ones((len(v), 1)), s], 1).astype(np.float32)
    bias = (p["R"][np.abs(_BEFORE)] + _CAUSAL).astype(np.float32)
    times, after, begin = tables(model)
    out_of, shift = p["U"].astype(np.float32), p["B"].astype(np.float32)
    got = model.inside[ids] + model.pairs[cls, goal]
    lead = model.leads[ids]
    any_lead = np.zeros(len(ids))
    first, size, skip = windows(counts)
    at_all = np.arange(WINDOW)
    for b in range(0, len(first), batch):
        f, n = first[b : b + batch], size[b : b + batch]
        at = np.minimum(f[:, None] + at_all, (f + n - 1)[:, None])
        x = table[rows[at]]
        w = x[..., :WIDTH] @ x[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1)
        w += bias
        np.exp(w, out=w)
        got_v = w @ x[..., 2 * WIDTH : 3 * WIDTH + 1]
        scored = (at_all >= skip[b : b + batch, None]) & (at_all < n[:, None])
        h = np.tanh((got_v[..., :WIDTH] / got_v[..., WIDTH:] + x[..., 3 * WIDTH + 1 :])[scored])
        to = at[scored]
        mixed = h @ out_of + shift
        np.exp(mixed, out=mixed)
        total = np.einsum("ij,ij->i", mixed, after[cls[to]])
        got[to] += np.log(np.einsum("ij,ij->i", mixed, times[goal[to]]) / total)
        some = lead[to]
        any_lead[to[some]] = np.log(np.einsum("ij,ij->i", mixed[some], begin[cls[to[some]]]) / total[some])
    return got, any_lead[lead]


def by_word(ids: np.ndarray, counts: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """Log probability of each word or end as its ids; n: words and end by text."""
    got, begins = logs(ids, counts, model)
    sizes = np.diff(np.append(np.flatnonzero(model.leads[ids]), len(ids)))
    out = shared.row_sums(got, sizes) - begins
    follow = np.append(begins[1:], 0.0)
    follow[np.cumsum(n) - 1] = 0.0  # nothing follows an end
    return out + follow


def mixed_log(spelt: np.ndarray, share: np.ndarray, weight: float) -> np.ndarray:
    """Log probability of words from that of their ids and their share of the training words."""
    return np.logaddexp(np.log1p(-weight) + spelt, np.log(np.maximum(weight * share, 1e-300)))


def tried(spelt: np.ndarray, share: np.ndarray) -> Iterator[np.ndarray]:
    """mixed_log() under each of WEIGHTS, of words of which none has a share of 0."""
    alone = np.exp(spelt)
    for w in WEIGHTS:
        yield np.log((1 - w) * alone + w * share)


def left_out(spelt: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Log probability of all these training words under each of WEIGHTS, each left out of its own count."""
    again = times > 1
    alone = spelt[~again]  # these have no other share
    return np.array([x.sum() for x in tried(spelt[again], (times[again] - 1) / n)]) + np.log1p(-WEIGHTS) * len(alone) + alone.sum()


def gradient(p: dict[str, np.ndarray], times: np.ndarray, after: np.ndarray, x: np.ndarray, before: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Of the mean log loss over the positions that are on: x, before and y are embedding row, class before and class of each.

    Besides the head's, what the topics' weights get: by class, and by class before for its share of all classes.
    """
    scale, lag = np.float32(1 / np.sqrt(WIDTH)), np.abs(_BEFORE)
    q, k, v, s = ((p["E"] @ p[n])[x] for n in ("Q", "K", "V", "S"))
    w = q @ k.transpose(0, 2, 1)
    w *= scale
    w += p["R"][lag] + _CAUSAL
    w -= w.max(2, keepdims=True)
    np.exp(w, out=w)
    w /= w.sum(2, keepdims=True)
    h = np.tanh(w @ v + s)
    z = h @ p["U"] + p["B"]
    z -= z.max(2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(2, keepdims=True)
    up, down = times[y], after[before]
    up_sum, down_sum = np.einsum("ijk,ijk->ij", z, up)[..., None], np.einsum("ijk,ijk->ij", z, down)[..., None]
    on = (on / max(on.sum(), 1)).astype(p["E"].dtype)[..., None]
    up_part, down_part = on / up_sum, on / down_sum
    dpi = down * down_part - up * up_part
    dz = z * (dpi - np.einsum("ijk,ijk->ij", dpi, z)[..., None])
    flat = lambda a: a.reshape(-1, a.shape[-1])
    own, shared_ = _spread(y.reshape(-1), flat(z * -up_part), CLASSES), _spread(before.reshape(-1), flat(z * down_part), CLASSES + 1)
    dh = dz @ p["U"].T * (1 - h * h)
    da = dh @ v.transpose(0, 2, 1)
    da -= np.einsum("ijk,ijk->ij", da, w)[..., None]
    da *= w
    dv, dq, dk = w.transpose(0, 2, 1) @ dh, da @ k * scale, da.transpose(0, 2, 1) @ q * scale
    d = _spread(x.reshape(-1), np.concatenate([flat(dq), flat(dk), flat(dv), flat(dh)], 1), ROWS + 1)
    parts = dict(zip(("Q", "K", "V", "S"), np.split(d, 4, 1), strict=True))
    g = {n: p["E"].T @ part for n, part in parts.items()}
    g["E"] = sum(part @ p[n].T for n, part in parts.items())
    g["U"], g["B"] = flat(h).T @ flat(dz), dz.sum((0, 1))
    g["R"] = np.bincount(lag.reshape(-1), da.sum(0).reshape(-1), WINDOW)
    return g, own, shared_


def _spread(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by place."""
    order = np.argsort(at, kind="stable")
    key = at[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[key[begin]] = np.add.reduceat(rows[order], begin, 0)
    return out


class Descent:
    """Adam over windows as they come, in one partition."""

    def __init__(self, model: Model):
        self.model = model
        self.share = np.exp(model.pairs).astype(np.float32)
        self.p = {k: x.astype(np.float32) for k, x in model.params.items()}
        self.m, self.u = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        self.t = self.taken = 0
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.topics()

    def topics(self) -> None:
        self.times = np.exp(self.p["M"])
        self.after = self.share @ self.times
        self.own, self.shared = np.zeros_like(self.times), np.zeros_like(self.after)

    def add(self, ids: np.ndarray, counts: np.ndarray, take: Callable[[np.ndarray], np.ndarray]) -> None:
        """Descends over the windows of all texts that take() picks by their number in the partition."""
        rows, cls = context(ids, counts, self.model)
        goal = self.model.class_of[ids]
        first, size, _ = windows(counts)
        mine = np.flatnonzero(take(np.arange(self.taken, self.taken + len(first))))
        self.taken += len(first)
        first, size = first[mine], size[mine]
        at = np.minimum(first[:, None] + np.arange(WINDOW), (first + size - 1)[:, None])
        self.kept.append((rows[at], cls[at], goal[at], np.arange(WINDOW) < size[:, None]))
        if sum(len(k[0]) for k in self.kept) >= BATCH:
            self.flush(rest=False)

    def flush(self, rest: bool = True) -> None:
        if self.kept:
            whole = [np.concatenate(c) for c in zip(*self.kept, strict=True)]
            n = len(whole[0])
            upto = n if rest else n - n % BATCH
            for i in range(0, upto, BATCH):
                self.step(*(c[i : min(i + BATCH, upto)] for c in whole))
            self.kept = [tuple(c[upto:] for c in whole)] if upto < n else []
        if rest:
            self.step_topics()

    def step(self, x: np.ndarray, before: np.ndarray, y: np.ndarray, on: np.ndarray) -> None:
        self.t += 1
        g, own, shared_ = gradient(self.p, self.times, self.after, x, before, y, on)
        self.own += own
        self.shared += shared_
        for name in g:
            self.descend(name, g[name], self.t)
        if self.t % EVERY == 0:
            self.step_topics()

    def step_topics(self) -> None:
        since = self.t % EVERY or EVERY
        if self.own.any():
            self.descend("M", (self.own + self.share.T @ self.shared) * self.times / since, -(-self.t // EVERY))
            self.topics()

    def descend(self, name: str, g: np.ndarray, t: int) -> None:
        slow = 1 / np.sqrt(1 + self.t / 200)
        m, u = self.m[name], self.u[name]
        m += 0.1 * (g - m)
        u += 0.01 * (g * g - u)
        self.p[name] -= (RATES.get(name, RATE) * slow / (1 - 0.9**t) * m / (np.sqrt(u / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def tokenised(docs: DataFrame, held_out: Column, vocabulary: str) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, held_out, text and ids of every row, as a table; how often each id is in the rows that aren't held out)."""
    end = Encoder(vocabulary).library.get_vocab_size()
    wide = "<u2" if end <= 0xFFFF else "<u4"
    names, kinds = ["doc_id", "held_out", "text", "ids", "counts"], [pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.binary()]

    def rows(batches):
        coder, seen = coder_of(vocabulary), np.zeros(end + 1, np.int64)
        for own, buf, off in shared.pieces(batches):
            starts, ends, n = shared.spans(buf, off)
            ids, by_text, _ = subwords(coder, buf, starts, ends, n, end)
            out = np.asarray(own.column(1).to_pylist(), bool)
            seen += np.bincount(ids[~np.repeat(out, by_text)], minlength=end + 1)
            at = pa.array(np.append(0, np.cumsum(by_text)) * np.dtype(wide).itemsize, pa.int32())
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(by_text), [None, at.buffers()[1], pa.py_buffer(ids.astype(wide).tobytes())])
            yield pa.RecordBatch.from_arrays([*own.columns, binary, pa.nulls(len(by_text), pa.binary())], names)
        yield shared.as_batch(names, [[None], [None], [None], [None], [seen.astype("<i8").tobytes()]], kinds)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    made = shared.written(shared.arrow(picked, rows, "doc_id long, held_out boolean, text string, ids binary, counts binary").withColumn("row", F.monotonically_increasing_id()))

    def add(batches):
        total = np.zeros(end + 1, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, "<i8")
        yield shared.as_batch(["counts"], [[total.tobytes()]], [pa.binary()])

    # a row for each task that tokenised, summed in a few and then here
    sums = shared.arrow(made.filter("counts is not null").select("counts").repartition(8), add, "counts binary").collect()
    tokens = sum((np.frombuffer(r.counts, "<i8") for r in sums), np.zeros(end + 1, np.int64))
    return made.filter("counts is null").drop("counts"), tokens


def _ids(column: pa.Array, wide: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids by text)."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(wide).itemsize
    return np.frombuffer(data, wide)[off[0] // size : off[-1] // size].astype(np.int64), np.diff(off) // size


def runs(batches: Iterator[pa.RecordBatch], column: int, size: int = IDS) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of whole rows of about so many bytes of a binary column."""
    for b in batches:
        end = np.cumsum(np.asarray(pc.binary_length(b.column(column))), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, to - at)
            at = to


def fit(texts: DataFrame, tokens: np.ndarray, vocabulary: str) -> tuple[Model, DataFrame, dict[str, int]]:
    """(model, counts of words by hash as a table, totals) from all rows of tokenised() that aren't held out."""
    coder = Encoder(vocabulary)
    end = coder.library.get_vocab_size()
    wide, leads = "<u2" if end <= 0xFFFF else "<u4", np.append(coder.leads[:end], True)
    order = tokens.astype(float)
    order[end] = order.max() + 1
    class_of = np.full(end + 1, CLASSES - 1, np.int64)
    class_of[np.argsort(-order, kind="stable")[: CLASSES - 1]] = np.arange(CLASSES - 1)
    learnt = texts.filter("not held_out")

    def tally(batches):
        pairs, texts = np.zeros((CLASSES + 1) * CLASSES, np.int64), 0
        words: list[tuple[np.ndarray, np.ndarray]] = []
        for own, buf, off in shared.pieces(batches):
            starts, ends, _ = shared.spans(buf, off)
            words.append(np.unique(shared.hashes(buf, starts, ends, shared.LOWER), return_counts=True))
            if len(words) > 16:
                words = [_merge(words)]
                if len(words[0][0]) > MOST_HELD:
                    yield from counts(WORD, words[0][0].view(np.int64), words[0][1])
                    words = []
            ids, n = _ids(own.column(1), wide)
            c = class_of[ids]
            before = np.concatenate([[CLASSES], c[:-1]])
            before[np.cumsum(n) - n] = CLASSES
            pairs += np.bincount(before * CLASSES + c, minlength=len(pairs))
            texts += len(n)
        h, c = _merge(words)
        yield from counts(WORD, h.view(np.int64), c)
        yield from counts(PAIR, np.flatnonzero(pairs), pairs[pairs > 0])
        yield from counts(TEXTS, np.zeros(1, np.int64), np.array([texts]))

    def counts(kind, key, n):
        for i in range(0, len(key), 100_000):
            yield shared.as_batch(["kind", "key", "n"], [np.full(len(key[i : i + 100_000]), kind), key[i : i + 100_000], n[i : i + 100_000]], [pa.int32(), pa.int64(), pa.int64()])

    raw = shared.arrow(learnt.select("text", "ids"), tally, "kind int, key long, n long")
    counted = shared.written(raw.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    small = counted.filter(F.col("kind") != WORD).toArrow()  # class pairs and one total
    kind, key, n = (np.asarray(small.column(i)) for i in range(3))
    pairs = np.zeros((CLASSES + 1) * CLASSES)
    pairs[key[kind == PAIR]] = n[kind == PAIR]
    pairs = pairs.reshape(CLASSES + 1, CLASSES)
    base = (pairs.sum(0) + 1) / (pairs.sum() + CLASSES)
    pairs = np.log((pairs + 20 * base) / (pairs.sum(1, keepdims=True) + 20))
    rest = class_of == CLASSES - 1
    inside = np.where(rest, np.log((tokens + 0.05) / (tokens[rest].sum() + 0.05 * rest.sum())), 0.0)
    rng = np.random.default_rng(0)
    shape = {"E": (ROWS + 1, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "S": (WIDTH, WIDTH)}
    params = {k: rng.normal(0, 0.3, s) for k, s in shape.items()} | {"R": np.zeros(WINDOW), "U": rng.normal(0, 0.3, (WIDTH, TOPICS)), "B": np.zeros(TOPICS), "M": rng.normal(0, 0.3, (CLASSES, TOPICS))}
    words = counted.filter(F.col("kind") == WORD).select(F.col("key").alias("h"), F.col("n").alias("c"))
    sums = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    documents = int(n[kind == TEXTS].sum())
    total = {"texts": documents, "n": sums["n"] + documents, "v": sums["v"] + (documents > 0)}
    # the commonest words by count, found from a histogram of eighths of powers of two: no task sorts them all
    level = F.floor(F.log2("c") * 8).cast("int")
    room, least = HEAD, 1 << 30
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        room -= r["count"]
        if room < 0:
            break
        least = r.level
    head = words.filter(level >= least).toArrow()
    h = np.asarray(head.column(0)).view(np.uint64)
    by_hash = np.argsort(h)
    model = Model(end, class_of, inside, leads, pairs, params, h[by_hash], np.asarray(head.column(1))[by_hash])
    for k in range(ROUNDS):
        train(learnt, model, wide, k)
    return model, words, total


def train(learnt: DataFrame, model: Model, wide: str, k: int) -> None:
    """A pass over all training rows: each partition descends from the model's parameters, which become their mean by windows.

    The passes share out the windows, each in one of them. What a partition gives are numbers as many as the
    parameters; they are summed by place, so that neither a task nor the driver gets more than one set.
    """
    names = list(model.params)
    shapes = [model.params[x].shape for x in names]
    known = learnt.sparkSession.sparkContext.broadcast(model)
    last = k == ROUNDS - 1

    def rows(batches):
        forget()
        now = Descent(known.value)
        take = lambda i: (i % FIRST > 0 if last else i % FIRST == 0) if ROUNDS > 1 else i >= 0
        for b in runs(batches, 0):
            now.add(*_ids(b.column(0), wide), take)
        now.flush()
        weight = float(now.t)
        flat = np.concatenate([now.p[x].reshape(-1).astype(np.float64) * weight for x in names] + [[weight]])
        yield shared.as_batch(["v"], [[flat]], [pa.list_(pa.float64())])

    made = shared.arrow(learnt.select("ids"), rows, "v array<double>")
    got = {r.at: r.v for r in made.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()}
    size = [int(np.prod(s)) for s in shapes]
    flat = np.array([got.get(i, 0.0) for i in range(sum(size) + 1)])
    if flat[-1] > 0:
        mean = flat[:-1] / flat[-1]
        model.params = {x: part.reshape(s) for x, part, s in zip(names, np.split(mean, np.cumsum(size)[:-1]), shapes, strict=True)}


def _merge(words: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, at = np.unique(np.concatenate([w for w, _ in words]), return_inverse=True)
    return h, np.bincount(at, np.concatenate([c for _, c in words]), len(h)).astype(np.int64)


def scores(texts: DataFrame, fitted: tuple[Model, DataFrame, dict[str, int]], wide: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of tokenised().

    A model that has no weight gets it here: each row is scored under all of WEIGHTS, and each task adds up what the
    words of its training rows say for each of them.
    """
    spark = texts.sparkSession
    model, words, total = fitted
    known = spark.sparkContext.broadcast(model)
    below = np.log10(total["n"] + total["v"] + 1)
    last = np.log10(total["texts"] + 1) - below
    every = max(total["n"], 1)
    names = ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "tail", "votes"]
    some = pa.list_(pa.struct([("h", pa.int64()), ("spelt", pa.float64())]))
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), some, pa.list_(pa.float64())]

    def rows(batches):
        forget()
        model = known.value
        votes = np.zeros(len(WEIGHTS))
        for own, buf, off in shared.pieces(batches):
            starts, ends, n = shared.spans(buf, off)
            times = model.count(key := shared.hashes(buf, starts, ends, shared.LOWER))
            found = times >= 0
            value = np.where(found, np.log10(np.maximum(times, 0) + 1.0) - below, 0.0)
            ids, counts = _ids(own.column(3), wide)
            spelt = by_word(ids, counts, n + 1, model)
            here = np.insert(found, np.cumsum(n), True)
            times = np.insert(times, np.cumsum(n), total["texts"])[here]
            by_row = shared.row_sums(here.astype(np.int64), n + 1)
            if total["texts"]:
                mixed = tried(spelt[here], times / every) if model.weight is None else [mixed_log(spelt[here], times / every, model.weight)]
            else:  # only ends are here, and none was learnt
                mixed = [np.log1p(-w) + spelt[here] for w in (WEIGHTS if model.weight is None else [model.weight])]
            score = np.stack([shared.row_sums(x, by_row) for x in mixed], 1) / np.log(10)
            if model.weight is None:
                learnt = np.repeat(~np.asarray(own.column(1).to_pylist(), bool), by_row)
                votes += left_out(spelt[here][learnt], times[learnt], every)
            cut = np.concatenate([[0], np.cumsum(shared.row_sums((~found).astype(np.int64), n))])
            tail = pa.StructArray.from_arrays([pa.array(key[~found].view(np.int64)), pa.array(spelt[~here])], ["h", "spelt"])
            scored = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * score.shape[1], pa.int32()), pa.array(score.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), own.column(2), pa.array(n + 1, pa.int64()), pa.array(shared.row_sums(found.astype(np.int64), n)), pa.array(shared.row_sums(value, n) + last), scored, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), tail), pa.nulls(len(n), kinds[-1])],
                names,
            )
        yield shared.as_batch(names, [[None]] * (len(names) - 1) + [[votes]], kinds)

    out = shared.written(shared.arrow(texts.select("doc_id", "held_out", "row", "ids", "text"), rows, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, score array<double>, tail array<struct<h: long, spelt: double>>, votes array<double>"))
    made = out.filter("votes is null")
    # what the rarer words add: their counts come by a join, and count as those of the broadcast ones do
    rare = made.select("row", "held_out", F.inline("tail")).join(words, "h", "left")
    if model.weight is None:
        kinds_of = [F.sum(F.col("votes")[i]).alias(f"w{i}") for i in range(len(WEIGHTS))]
        votes = np.array(out.agg(*kinds_of).first(), float)
        again = F.greatest(F.col("c") - 1, F.lit(0)) / every
        if total["v"] > len(model.words) + 1:
            more = rare.filter("not held_out").agg(*[F.sum(F.log(float(w) * again + float(1 - w) * F.exp("spelt") + F.lit(1e-300))) for w in WEIGHTS]).first()
            votes += np.array([x or 0.0 for x in more])
        model.weight = float(WEIGHTS[votes.argmax()])
        at = int(votes.argmax())
    else:
        at = 0
    count = F.coalesce("c", F.lit(0))
    mixed = F.log10(F.lit(model.weight / every) * count + F.lit(1 - model.weight) * F.exp("spelt") + F.lit(1e-300))
    summed = rare.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(count + 1.0) - F.lit(float(below))).alias("part"), F.sum(mixed).alias("mixed"))
    end_known = F.lit(int(total["texts"] > 0))
    return made.drop("tail").join(summed, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0)) + end_known).alias("n_known"), F.lit(int(total["n"])).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("part", F.lit(0.0))).alias("base_score"), (F.col("score")[at] + F.coalesce("mixed", F.lit(0.0))).alias("score"),
    )


def learn_and_score(docs: DataFrame, held_out: Column, vocabulary: str) -> DataFrame:
    """scores() of every row of docs by a model of those that aren't held out."""
    texts, tokens = tokenised(docs, held_out, vocabulary)
    return scores(texts, fit(texts, tokens, vocabulary), "<u2" if len(tokens) - 1 <= 0xFFFF else "<u4")
