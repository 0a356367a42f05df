"""Ranked lexical search over an index of compressed posting blocks, with Block-Max WAND.

index() cuts the documents into shards of about SHARD bytes of text, each by a task where it reads them. In a shard a
term's postings (document and count) stand in blocks of BLOCK, packed in as many bits as the block's widest gap and count
need; a block's row holds its first and last document and the greatest impact in it, so what it can add to a score is
known without unpacking it. The index holds every term of every row; the two sums over the corpus that impacts need
come from a pass before it.

search() sends the blocks of the items' terms, shard by shard, to tasks that keep each item's best k over all their
shards. In a shard an item has one pointer for a term. By the terms' greatest impacts the first document that can
reach the item's k-th score is its pivot; shallow moves bring the pointers to the blocks that hold the pivot; if the
sum of those blocks' impacts is too small, the pointers go on behind the nearest end of a block, and nothing is
unpacked. Otherwise the documents from the pivot on, SPAN of them, are scored together from their unpacked blocks. The k-th
score carries over from shard to shard. A document that ties with it is scored, so ties go by doc_id as they should.

A document: a row with a term. Null text has none, and such rows are never found. Equal rows are found each for itself;
equal scores go by doc_id, null first. Rows of one item_id are one item with the terms of all; items without terms, or
whose terms no document holds, have no rows. Texts of any length are taken whole. An empty table of either kind
gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .divergence import taken

BLOCK, SHARD, SPAN = 128, 8 << 20, 1024
#: Values that are packed at once.
PACKED = 1 << 16
#: Documents of a shard, however short they are.
MOST_DOCS = 1 << 17
#: Terms of items that a search holds at once (some 50 bytes each in every task); more items go in turn.
MOST_TERMS = 500_000
#: Every ASCII byte that is no letter or digit parts terms.
BREAKS = np.ones(256, bool)
BREAKS[48:58] = BREAKS[65:91] = BREAKS[97:123] = BREAKS[128:] = False
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCHEMA = "shard long, term string, block int, n int, first int, last int, top long, data binary, ids array<long>, sizes array<long>"
_KINDS = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("block", pa.int32()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("top", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


@dataclasses.dataclass
class Index:
    """blocks: a row for each block, and one without a term for each shard, with its documents' ids and sizes."""

    blocks: DataFrame
    documents: int
    terms: int


def impacts(tf: np.ndarray, size: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A term's share of a document's score, before its weight."""
    m = 75 + 25 * size * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(documents: int, holding: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((2 * F.lit(documents).cast("long") + 2) / (2 * holding + 1))).cast("long")


def packed(values: np.ndarray, widths: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """size bytes with each value's low bits from its own bit on."""
    bits = np.zeros(8 * size, np.uint8)
    for i in range(0, len(values), PACKED):
        v, w, a = (x[i : i + PACKED] for x in (values, widths, at))
        of = np.repeat(np.arange(len(v)), w)
        place = np.arange(len(of)) - np.repeat(np.cumsum(w) - w, w)
        bits[a[of] + place] = (v[of] >> place) & 1
    return np.packbits(bits, bitorder="little")


def unpacked(data: bytes, n: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, counts) of a block."""
    gap, count = data[0], data[1]
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=2), bitorder="little")
    docs = np.full(n, first, np.int64)
    if gap:
        docs[1:] += bits[: (n - 1) * gap].reshape(n - 1, gap) @ (1 << np.arange(gap))
    docs[1:] += 1
    docs[1:] -= first
    tf = np.ones(n, np.int64)
    if count:
        tf += bits[(n - 1) * gap : (n - 1) * gap + n * count].reshape(n, count) @ (1 << np.arange(count))
    return np.cumsum(docs), tf


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value takes."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def blocks_of(key: np.ndarray, doc: np.ndarray, tf: np.ndarray, top: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    """Postings in order of key and document as blocks; at: where each begins."""
    run = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(run, len(key)))
    within = np.arange(len(key)) - np.repeat(run, size)
    at = np.flatnonzero(within % BLOCK == 0)
    n = np.diff(np.append(at, len(key)))
    of = np.repeat(np.arange(len(at)), n)
    gaps = np.append(0, np.diff(doc)) - 1
    gaps[at] = 0
    wide = [_bits(np.maximum.reduceat(v, at)) for v in (gaps, tf - 1)]
    length = 2 + -(-((n - 1) * wide[0] + n * wide[1]) // 8)
    begin = np.cumsum(length) - length
    place = np.arange(len(key)) - at[of]
    heads = np.repeat(begin * 8, 2) + np.tile([0, 8], len(at))
    widths = np.where(place > 0, wide[0][of], 0), wide[1][of]
    bit = begin[of] * 8 + 16
    where = bit + np.maximum(place - 1, 0) * wide[0][of], bit + (n - 1)[of] * wide[0][of] + place * wide[1][of]
    data = packed(np.concatenate([np.column_stack(wide).ravel(), gaps, tf - 1]), np.concatenate([np.full(len(heads), 8), *widths]), np.concatenate([heads, *where]), int(length.sum()))
    packs = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(begin, length.sum()).astype(np.int32)), pa.py_buffer(data)])
    return {"at": at, "n": n, "block": within[at] // BLOCK, "first": doc[at], "last": doc[at + n - 1], "top": np.maximum.reduceat(top, at), "data": packs}


def index(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> Index:
    """Every row of docs that has a term."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def sums(batches):
        n = total = 0
        for _, buf, off in shared.pieces(batches):
            sizes = shared.spans(buf, off, BREAKS)[2]
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        yield shared.as_batch(["n", "total"], [[n], [total]], [pa.int64()] * 2)

    whole = shared.arrow(rows, sums, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).head()
    documents, terms = whole.n, whole.total

    def shards(batches):
        number, held, parts = TaskContext.get().partitionId() << 32, 0, []
        for b, buf, off in shared.pieces(batches):
            starts, ends, sizes = shared.spans(buf, off, BREAKS)
            low = shared.LOWER[buf]
            key = shared.hashes(low, starts, ends)
            row = np.repeat(np.arange(b.num_rows), sizes)
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            one = np.flatnonzero(np.append(True, key[begin][1:] != key[begin][:-1])) if len(begin) else begin
            first = order[begin[one]]
            parts.append((b.column(0), sizes, key[begin], row[begin], np.diff(np.append(begin, len(key))), key[begin[one]], taken(low, starts[first], ends[first])))
            held += len(buf) + SHARD // MOST_DOCS * b.num_rows
            if held >= SHARD:
                yield from shard(number, parts)
                number, held, parts = number + 1, 0, []
        if parts:
            yield from shard(number, parts)

    def shard(number, parts):
        ids = pa.chunked_array([p[0] for p in parts], pa.int64())
        sizes = np.concatenate([p[1] for p in parts])
        have = np.flatnonzero(sizes)
        if not len(have):
            return
        null, value = np.asarray(ids.is_null())[have], np.asarray(ids.fill_null(0))[have]
        order = have[np.lexsort((value, ~null))]
        rank = np.zeros(len(sizes), np.int64)
        rank[order] = np.arange(len(order))
        base = np.cumsum([0, *(len(p[1]) for p in parts)])
        key, tf = (np.concatenate([p[i] for p in parts]) for i in (2, 4))
        doc = rank[np.concatenate([p[3] + base[i] for i, p in enumerate(parts)])]
        sort = np.lexsort((doc, key))
        key, doc, tf = key[sort], doc[sort], tf[sort]
        sizes = sizes[order]
        made = blocks_of(key, doc, tf, impacts(tf, sizes[doc], documents, terms))
        names, strings = np.concatenate([p[5] for p in parts]), pa.chunked_array([p[6] for p in parts], pa.string()).combine_chunks()
        _, where = np.unique(names, return_index=True)
        term = strings.take(pa.array(where[np.searchsorted(names[where], key[made["at"]])]))
        yield pa.RecordBatch.from_pydict({"shard": [number], "term": [None], "block": [0], "n": [len(order)], "first": [0], "last": [len(order) - 1], "top": [0], "data": [None], "ids": [ids.take(pa.array(order)).to_pylist()], "sizes": [sizes]}, schema=_KINDS)
        count = len(made["at"])
        nothing = pa.nulls(count, pa.list_(pa.int64()))
        columns = {"shard": np.full(count, number), "term": term, **{k: made[k] for k in ("block", "n", "first", "last", "top", "data")}, "ids": nothing, "sizes": nothing}
        whole = pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k.type) for c, k in zip(columns.values(), _KINDS, strict=True)], schema=_KINDS)
        yield from whole.to_batches(1 << 14)

    return Index(shared.written(shared.arrow(rows, shards, SCHEMA)), documents, terms)


class Shard:
    """The blocks of one shard for the terms that are asked for, and what of them has been unpacked."""

    def __init__(self, ids: list, sizes: list, documents: int, terms: int):
        self.value = np.array([i or 0 for i in ids], np.int64)
        self.null = np.array([i is None for i in ids])
        self.sizes, self.corpus = np.array(sizes, np.int64), (documents, terms)
        self.blocks: dict[str, list] = {}
        self.lists: dict[str, Postings] = {}

    def close(self) -> None:
        self.lists = {t: Postings(x) for t, x in self.blocks.items()}

    def scored(self, term: str, begin: int, end: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) from low to before high, of these blocks."""
        x = self.lists[term]
        if not x.ready[begin:end].all():
            for i in np.flatnonzero(~x.ready[begin:end]) + begin:
                place = slice(x.at[i], x.at[i + 1])
                docs, tf = unpacked(x.data[i], int(x.at[i + 1] - x.at[i]), int(x.first[i]))
                x.docs[place], x.impacts[place], x.ready[i] = docs, impacts(tf, self.sizes[docs], *self.corpus), True
        a, b = int(x.at[begin]), int(x.at[end])
        docs = x.docs[a:b]
        if docs[0] < low or docs[-1] >= high:
            i, j = docs.searchsorted((low, high))
            a, b = a + int(i), a + int(j)
        return x.docs[a:b], x.impacts[a:b]


class Postings:
    """A term's blocks in a shard; docs and impacts are there where a block is ready, that is unpacked."""

    def __init__(self, blocks: list[tuple]):
        first, last, top, n, self.data = zip(*blocks, strict=True)
        self.first, self.last, self.top = np.array(first), np.array(last), np.array(top, np.int64)
        self.at = np.cumsum([0, *n])
        self.docs, self.impacts = np.empty(self.at[-1], np.int64), np.empty(self.at[-1], np.int64)
        self.ready = np.zeros(len(first), bool)


class Best:
    """The k best of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.null, self.value = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score from which a document counts."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score, null, value) -> None:
        score, null, value = np.append(self.score, score), np.append(self.null, null), np.append(self.value, value)
        order = np.lexsort((value, ~null, -score))[: self.k]
        self.score, self.null, self.value = score[order], null[order], value[order]


def block_max_wand(shard: Shard, query: list[tuple[str, int]], best: Best) -> None:
    """Adds the shard's documents that belong to the item's best. query: (term, weight)."""
    terms = [(t, w) for t, w in query if w > 0 and t in shard.lists]
    lists = [shard.lists[t] for t, _ in terms]
    weights = np.array([w for _, w in terms], np.int64)
    most = np.array([int(x.top.max()) for x in lists], np.int64) * weights
    if most.sum() < best.least:
        return
    # all blocks of all terms in one array, so that the shallow moves of all pointers are one step
    length = np.array([len(x.first) for x in lists])
    base = np.cumsum(length) - length
    first, last, top = (np.concatenate([getattr(x, c) for x in lists]) for c in ("first", "last", "top"))
    top = top * np.repeat(weights, length)
    n = len(shard.sizes)
    at = base.copy()  # each pointer's block
    live = np.arange(len(terms))
    x = 0
    while True:
        while True:  # shallow moves: blocks that end before x are passed by
            behind = last[at[live]] < x
            if not behind.any():
                break
            at[live[behind]] += 1
            live = live[at[live] < base[live] + length[live]]
            if not len(live):
                return
        here = np.maximum(first[at[live]], x)
        order = np.argsort(here, kind="stable")
        reach = np.cumsum(most[live[order]])
        least = best.least
        i = int(np.searchsorted(reach, least))
        if i == len(order):
            return
        pivot = int(here[order[i]])
        before = live[here <= pivot]
        moved = at[before].copy()
        while (behind := last[moved] < pivot).any():
            moved[behind] += 1
            inside = moved < base[before] + length[before]
            before, moved = before[inside], moved[inside]
        inside = first[moved] <= pivot
        if int(top[moved[inside]].sum()) < least:
            # no document up to the nearest end of these blocks, or the next beginning, can count
            ends = [last[moved[inside]] + 1, first[moved[~inside]], here[here > pivot]]
            x = int(min(e.min() for e in ends if len(e)))
            continue
        end = min(max(int(last[moved[inside]].min()) + 1, pivot + SPAN), n)
        score = np.zeros(end - pivot, np.int64)
        for t, b in zip(live.tolist(), (at[live] - base[live]).tolist(), strict=True):
            name, w = terms[t]
            x = lists[t]
            # of this term's blocks those with documents from the pivot to before the end
            b, e = b + int(x.last[b:].searchsorted(pivot)), int(x.first.searchsorted(end))
            if b < e:
                docs, impact = shard.scored(name, b, e, pivot, end)
                score[docs - pivot] += w * impact
        good = np.flatnonzero(score >= least)
        if len(good):
            best.add(score[good], shard.null[pivot + good], shard.value[pivot + good])
        x = end
        if x >= n:
            return


def words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _UPPER.lower()), BREAK), "")


def search(found: Index, items: DataFrame, k: int = 20, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""
    spark = items.sparkSession
    item = items.select(F.col(id_column).cast("long").alias("item"), F.explode(words(text)).alias("term"))
    asked = shared.kept(item.groupBy("item", "term").agg(F.count("*").alias("q")))
    n = asked.count()
    parts = -(-n // MOST_TERMS)
    posts = found.blocks.filter("term is not null")
    of_term = asked.select("term").distinct()
    holding = posts.join(F.broadcast(of_term) if parts <= 1 else of_term, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weighted = shared.kept(asked.join(holding, "term").select("item", "term", (F.col("q") * weight(found.documents, F.col("df"))).alias("w")).filter("w > 0"))
    documents, terms, out = found.documents, found.terms, None
    for part in range(parts):
        mine = weighted.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else weighted
        queries: dict = {}
        for r in mine.toLocalIterator():  # about MOST_TERMS short rows
            queries.setdefault(r.item, []).append((r.term, r.w))
        shipped = spark.sparkContext.broadcast(queries)
        there = found.blocks.join(F.broadcast(mine.select(F.col("term").alias("__term")).distinct()), F.col("term") == F.col("__term"), "left_semi").unionByName(found.blocks.filter("term is null"))

        def ranked(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            best = {i: Best(k) for i in shipped.value}
            number, shard = None, None

            def done():
                if shard is not None and shard.blocks:
                    shard.close()
                    for i, query in shipped.value.items():
                        block_max_wand(shard, query, best[i])

            for b in batches:
                column = {c: b.column(j).to_pylist() for j, c in enumerate(b.schema.names)}
                for j in range(b.num_rows):
                    if column["shard"][j] != number:
                        done()
                        number, shard = column["shard"][j], Shard(column["ids"][j], column["sizes"][j], documents, terms)
                    else:
                        shard.blocks.setdefault(column["term"][j], []).append(tuple(column[c][j] for c in ("first", "last", "top", "n", "data")))
            done()
            for some in shared.chunked(best.items(), 1024):
                each = [(i, None if null else v, s) for i, x in some for s, null, v in zip(x.score.tolist(), x.null.tolist(), x.value.tolist(), strict=True)]
                if each:
                    yield shared.as_batch(["item_id", "doc_id", "score"], list(zip(*each, strict=True)), [pa.int64()] * 3)

        dealt = there.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first(), "block")
        of_part = shared.arrow(dealt, ranked, "item_id long, doc_id long, score long")
        out = of_part if out is None else out.union(of_part)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    # each task sends k rows an item at most, and the limit goes below this shuffle too
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
