"""N-gram Jaccard self-join as T-occurrence search.

A document is the set of its K-word shingles. Two sets of a and b shingles have a Jaccard similarity of
PERCENT or more if and only if they share T = ceil(PERCENT (a + b) / (100 + PERCENT)) shingles. Shingles
are ordered by the length of their inverted lists over the whole corpus, the shortest first. As in
DivideSkip, a set's T - 1 longest lists are set aside: whoever shares T shingles meets it in one of the
rest, so only those short lists are built, as a distributed index, and merged. The long lists are probed
by binary search for the few candidates that the merge leaves.

Sets that are equal become one node first, named by the set's signature. A list isn't expanded into its
pairs: each round takes hubs from it and tests the others against them, unless a link already joins them:
first the member with the least signature, then, as signatures are hashes, those whose signature is under
16 / m, 256 / m, ... of their range in a list of m. No task has to see a whole list for that. A list is
done when its members are in one component or each has been tested against each. So every link between
different sets is found or already implied by others.

Texts without words have an empty set and no links; null texts are empty. Ties in length go by hash. Equal rows
are one node and each has its row of the result; a null id stays null, and a component whose ids are all null is
named by none. A text of any length is one set. Ids are taken as integers; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .graph import components

K, PERCENT = 4, 85
#: List lengths are kept for so many groups of shingles, and sent in rows of so many.
GROUPS, ROW = 1 << 20, 1 << 12
#: Documents that one query is run against at a time.
BLOCK = 256
#: Ids that are broadcast (some 30 bytes each); beyond, both sides are shuffled.
MOST_BROADCAST = 250_000
#: Sets that a task remembers having sent; a forgotten one is sent again and dropped later.
SEEN = 50_000
#: Weighs the cost of a merge against that of a binary search.
MU = 0.01


def sets(buf: np.ndarray, off: np.ndarray, k: int = K) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    starts, ends, counts = shared.spans(buf, off)
    keys, made = shared.shingles(shared.hashes(buf, starts, ends, shared.LOWER), counts, k)
    for s in np.split(keys, np.cumsum(made)[:-1]):
        s = np.sort(s)
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def signature(s: np.ndarray) -> int:
    total = np.add.reduce(shared.mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(s))
    return int(shared.mix(np.array([total], np.uint64)).view(np.int64)[0])


def divide_skip(query: np.ndarray, members: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Which members share the shingles that the similarity asks for with the query.

    The members' inverted lists of the query's shingles are split: the L longest are probed by binary
    search, the others merged with a heap; who is met less than T - L times there is out.
    """
    need = [-(-percent * (len(query) + len(m)) // (100 + percent)) for m in members]
    at = [np.searchsorted(query, m) for m in members]
    lists: list[list[int]] = [[] for _ in range(len(query))]
    for i, (a, m) in enumerate(zip(at, members, strict=True)):
        inside = np.minimum(a, max(len(query) - 1, 0))
        for j in inside[query[inside] == m].tolist() if len(query) else ():
            lists[j].append(i)
    lists = sorted(filter(None, lists), key=len)
    if not lists:
        return []
    least = min(need)
    skipped = min(least - 1, int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)), len(lists))
    short, long = lists[: len(lists) - skipped], lists[len(lists) - skipped :]
    met = Counter(heapq.merge(*short))
    found = []
    for i, n in met.items():
        if n < need[i] - len(long):
            continue
        left = len(long)
        for x in reversed(long):
            if n >= need[i] or n + left < need[i]:
                break
            k = bisect_left(x, i)
            n += k < len(x) and x[k] == i
            left -= 1
        if n >= need[i]:
            found.append(i)
    return found


def _lengths(sketch: DataFrame) -> np.ndarray:
    """How many documents each group of shingles is in, over all documents."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        yield shared.as_batch(["block", "counts"], [list(total), [x.tobytes() for x in total.values()]], [pa.int32(), pa.binary()])

    summed = shared.arrow(sketch.filter("block is not null").select("block", "counts").repartition("block"), add, "block int, counts binary")
    out = np.zeros(GROUPS, np.int64)
    for r in summed.collect():  # GROUPS numbers, whatever the input
        out[r.block * ROW : (r.block + 1) * ROW] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def join(docs: DataFrame, id_column: str = "doc_id", k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every row of docs."""
    known, of = classes(docs, id_column, k, percent)
    named = of.join(shared.dealt(of.groupBy("comp").agg(F.min("doc_id").alias("component_id"))), "comp").select("sig", "component_id")
    out = known.join(shared.dealt(named), "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def surplus(docs: DataFrame, id_column: str = "doc_id", k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, h (the text's xxhash64) and n of the rows that one document of their class stands for; n more than one: of equal ones.

    Of each class the row of the least doc_id stays, an id before none; of rows of one id that with the least h. stays
    says whether a row of this id and text does. So rows of equal ids, or of none, with different texts are different documents.
    """
    known, of = classes(docs, id_column, k, percent)
    rows = known.filter("sig is not null").groupBy("sig", "doc_id", "h").agg(F.count("*").alias("n")).join(shared.dealt(of.select("sig", "comp")), "sig")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = rows.groupBy("comp").agg(F.min(order).alias("first"))
    return rows.join(shared.dealt(first), "comp").select("doc_id", "h", "n", order.eqNullSafe(F.col("first")).alias("stays")).filter("n > 1 or not stays")


def classes(docs: DataFrame, id_column: str = "doc_id", k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n and sig of each row; sig, the least doc_id and comp of each set), h: the text's hash, comp: the least sig that links reach."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sketches(batches):
        count = np.zeros(GROUPS, np.uint32)
        names, kinds = ["doc_id", "h", "n", "sig", "block", "counts"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for rows, buf, off in shared.pieces(batches):
            found = list(sets(buf, off, k))
            np.add.at(count, (np.concatenate(found) & np.uint64(GROUPS - 1)).astype(np.int64), np.uint32(1))
            none = [None] * len(found)
            yield shared.as_batch(names, [rows.column(0), rows.column(2), [len(s) for s in found], [signature(s) if len(s) else None for s in found], none, none], kinds)
        blocks = [b for b in range(GROUPS // ROW) if count[b * ROW : (b + 1) * ROW].any()]
        none = [None] * len(blocks)
        yield shared.as_batch(names, [none, none, none, none, blocks, [count[b * ROW : (b + 1) * ROW].tobytes() for b in blocks]], kinds)

    sketch = shared.written(shared.arrow(docs.withColumn("h", F.xxhash64("text")), sketches, "doc_id long, h long, n long, sig long, block int, counts binary"))
    lengths = spark.sparkContext.broadcast(_lengths(sketch))
    known = sketch.filter("block is null").select("doc_id", "h", "n", "sig")
    nodes = shared.kept(known.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id")))

    def short_lists(batches):
        seen: set[int] = set()
        for _, buf, off in shared.pieces(batches):
            out = []
            if len(seen) > SEEN:
                seen.clear()
            for s in sets(buf, off, k):
                if not len(s) or (sig := signature(s)) in seen:
                    continue
                seen.add(sig)
                n = len(s)
                order = np.argsort(lengths.value[(s & np.uint64(GROUPS - 1)).astype(np.int64)], kind="stable")
                first = s[order[: n - -(-percent * n // 100) + 1]].view(np.int64)
                out.append((first, np.full(len(first), sig), np.full(len(first), n), np.arange(len(first))))
            if out:
                yield shared.as_batch(_ENTRY, [np.concatenate(c) for c in zip(*out, strict=True)], _KINDS)

    index = shared.arrow(docs, short_lists, "key long, sig long, n int, pos int").repartition("key").sortWithinPartitions("key", "sig")
    lists = shared.written(shared.arrow(index, several, "key long, sig long, n int, pos int, hub struct<sig: long, n: int, pos: int>"))
    fits = F.expr(f"{100 + percent} * least(n - pos, hub.n - hub.pos) >= {percent} * (n + hub.n)")
    first = shared.kept(lists.filter((F.col("sig") != F.col("hub.sig")) & fits).select(F.col("hub.sig").alias("a"), F.col("sig").alias("b")).distinct())
    lists = lists.select("key", "sig", "n", "pos").join(shared.dealt(lists.groupBy("key").agg(F.count("*").alias("m")).filter("m >= 3")), "key")
    comp = components(_linked(first, docs, nodes, k, percent))
    at, more, last = 0, 16, None
    while True:
        named = lists.join(shared.dealt(comp).withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        split = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("m").alias("m")).filter(f"low <> high and m > {at}")
        lists = shared.kept(named.join(shared.dealt(split.select("key")), "key"))
        if last is not None:
            shared.drop(last)
        last = lists
        if lists.isEmpty():
            break
        # a signature is a hash, so this many of a list's members are hubs, wherever they lie
        place = F.expr("(cast(sig as double) / 18446744073709551616D + 0.5D) * m")
        hubs = lists.filter((place >= at) & (place < at + more)).select("key", F.struct("sig", "n", "pos").alias("hub"), F.col("comp").alias("of"))
        pairs = lists.join(shared.dealt(hubs), "key").filter((F.col("comp") != F.col("of")) & (F.col("sig") > F.col("hub.sig")) & fits)
        linked = _linked(shared.kept(pairs.select(F.col("hub.sig").alias("a"), F.col("sig").alias("b")).distinct()), docs, nodes, k, percent)
        name = lambda c: linked.join(shared.dealt(comp).select(F.col("node").alias(c), F.col("comp").alias(f"of_{c}")), c, "left").withColumn(c, F.coalesce(f"of_{c}", c)).drop(f"of_{c}")
        linked = name("a")
        linked = shared.kept(name("b").distinct())
        if not linked.isEmpty():
            merged = components(linked).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
            old = comp.union(linked.select(F.col("a").alias("node"), F.col("a").alias("comp"))).union(linked.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
            comp = shared.kept(old.join(shared.dealt(merged), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")).groupBy("node").agg(F.min("comp").alias("comp")))
        at, more = at + more, more * 16
        shared.tidy(spark)
        lists = lists.select("key", "sig", "n", "pos", "m")
    return known, nodes.join(shared.dealt(comp).withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))


_ENTRY, _KINDS = ["key", "sig", "n", "pos"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
_HUB = pa.struct([("sig", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of two or more sets, from entries sorted by key and signature; each entry once, with the list's first as its hub.

    Of the list at a batch's end only the first entry and the last signature are kept, so a list may be of any length.
    """
    held = hub = last = None  # the only entry so far of a list, the first entry of a longer one, and where the batch ended
    for b in batches:
        if not b.num_rows:
            continue
        key, sig, n, pos = (np.asarray(c) for c in b.columns)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        new[0] = last != (key[0], sig[0])
        last = key[-1], sig[-1]
        key, sig, n, pos = (c[new] for c in (key, sig, n, pos))
        front = held if held is not None else None
        if front is not None:
            key, sig, n, pos = (np.append(np.array([x], c.dtype), c) for x, c in zip(front, (key, sig, n, pos), strict=True))
        if not len(key):
            continue
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        going = hub is not None and key[0] == hub[0]
        keep = np.repeat((size > 1) | (going & (np.arange(len(size)) == 0)), size)
        of = np.repeat(begin, size)
        hubs = [c[of] for c in (sig, n, pos)]
        if going:
            for c, x in zip(hubs, hub[1:], strict=True):
                c[: size[0]] = x
        single = not keep[-1]
        held = (key[-1], sig[-1], n[-1], pos[-1]) if single else None
        if single:
            hub = None
        elif len(size) > 1 or not going:
            hub = tuple(c[begin[-1]] for c in (key, sig, n, pos))
        if keep.any():
            struct = pa.StructArray.from_arrays([pa.array(c[keep], t.type) for c, t in zip(hubs, _HUB, strict=True)], fields=list(_HUB))
            yield shared.as_batch([*_ENTRY, "hub"], [*(c[keep] for c in (key, sig, n, pos)), struct], [*_KINDS, _HUB])


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that are similar enough. A hub with many partners is dealt out in blocks of about BLOCK.

    Of the ids that are asked for the driver broadcasts each once, without who asks, and their texts alone are shuffled:
    to who asks, and on to the blocks. Where these ids are too many for that, all texts are.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = pairs.join(shared.dealt(blocks), "a").select("a", F.expr("pmod(xxhash64(b), blocks)").alias("salt"), "b")
    heads = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"), F.col("a").alias("b"))
    asked = shared.kept(members.union(heads).join(shared.dealt(nodes).select(F.col("sig").alias("b"), F.col("doc_id").alias("id")), "b"))
    ids = shared.kept(asked.select(F.coalesce("id", F.lit(0).cast("long")).alias("key")).distinct())  # none counts as 0 here, where more may pass
    some = docs.join(F.broadcast(ids), F.coalesce("doc_id", F.lit(0).cast("long")) == F.col("key"), "left_semi") if ids.count() <= MOST_BROADCAST else docs
    rows = some.join(shared.dealt(asked), F.col("doc_id").eqNullSafe(F.col("id"))).select("a", "salt", "b", (F.col("a") != F.col("b")).alias("member"), "text")

    def verify(batches):
        group, query, ids, held, out = None, None, [], [], []

        def close():
            if query is not None and held:
                out.extend((group[0], ids[i]) for i in divide_skip(query, held, percent))

        for rows, buf, off in shared.pieces(batches):
            for a, salt, b, s in zip(*(rows.column(i).to_pylist() for i in range(3)), sets(buf, off, k), strict=True):
                if (a, salt) != group:
                    close()
                    group, query, ids, held = (a, salt), None, [], []
                if not len(s) or signature(s) != b:
                    continue  # another row of the same id
                if a == b:
                    query = s
                else:
                    ids.append(b)
                    held.append(s)
            if out:
                yield shared.as_batch(["a", "b"], list(zip(*out, strict=True)), [pa.int64()] * 2)
                out.clear()
        close()
        if out:
            yield shared.as_batch(["a", "b"], list(zip(*out, strict=True)), [pa.int64()] * 2)

    in_blocks = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "member")
    found = shared.kept(shared.arrow(in_blocks, verify, "a long, b long"))
    del rows, in_blocks, some
    shared.tidy(docs.sparkSession)  # the driver's copy of the ids
    return found
