"""MinHash near-deduplication with b-bit signatures.

A document is the set of its K-word shingles; sets that are equal become one node first, named by the set's signature. Of
each set MINIMA minima are taken, each of another permutation of 32-bit hashes. BANDS bands of ROWS whole minima give the
candidates: sets with one band in common. Of a minimum only the low BITS bits are stored, MINIMA of them packed in
64-bit words. Two of J similarity agree in them with probability C + (1 - C) J, C = 2^-BITS being the chance that
different minima agree; so the agreements of a candidate pair, counted in a few bit operations, estimate J, and pairs
whose estimate is below LOOSE go. What is left is confirmed on the full sets.

At a similarity of exactly 0.85 a pair shares no band with probability (1 - 0.85^5)^25 = 4e-7, and falls below LOOSE,
4.8 standard deviations lower, with some 1e-6; a more similar pair yet more rarely. Lists of a band that many sets are
in go through hubs.classes(), so no list is expanded into its pairs.

Texts without words have an empty set and no links; null texts are empty. Equal rows are one node and each has its row
of the result; a null id stays null, and a component whose ids are all null is named by none. Ties need no order:
a component's name is its least id. A text of any length is one set. An empty table gives no rows. Ids are taken as
integers; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hubs, shared
from .toccurrence import _linked, sets, signature

K, PERCENT = 5, 85
MINIMA, BANDS, ROWS, BITS = 512, 25, 5, 4
#: The least estimate that is looked at closer.
LOOSE = 0.77
#: Sets that a task remembers having sent.
SEEN = 50_000
WORDS = MINIMA * BITS // 64
_RND = np.random.default_rng(7_281)
_TIMES, _PLUS = (_RND.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)


def minima(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of minima for each set; keys: the sets' shingles one after the other, none empty."""
    h = (keys >> np.uint64(32)).astype(np.uint32)
    begin = np.cumsum(counts) - counts
    out = np.empty((len(counts), MINIMA), np.uint32)
    for j in range(MINIMA):
        out[:, j] = np.minimum.reduceat(h * _TIMES[j] + _PLUS[j], begin)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each set."""
    out = np.empty((len(least), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(least), b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            key = shared.mix(key * np.uint64(0x9FB21C651E98DF25) + least[:, j])
        out[:, b] = key
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of each set's minima in WORDS words."""
    low = (least & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(least), WORDS, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def similarity(a: str, b: str) -> Column:
    """Estimated from two arrays of packed low bits, corrected for minima that agree by chance."""
    lane = sum(1 << i for i in range(0, 64, BITS))

    def differing(x: Column, y: Column) -> Column:
        x = x.bitwiseXOR(y)
        for s in (1, 2):  # a lane's lowest bit gathers its four
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        return F.bit_count(x.bitwiseAND(F.lit(lane)))

    differ = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n and sig (null: an empty set) of each row, and bits and bands where the task meets the set first."""

    def rows(batches):
        seen: set[int] = set()
        for b, buf, off in shared.pieces(batches):
            found = list(sets(buf, off, k))
            names = [signature(s) if len(s) else None for s in found]
            if len(seen) > SEEN:
                seen.clear()
            new = [i for i, x in enumerate(names) if x is not None and not (x in seen or seen.add(x))]
            bits, keys = [None] * len(found), [None] * len(found)
            if new:
                least = minima(np.concatenate([found[i] for i in new]), np.array([len(found[i]) for i in new]))
                for i, x, y in zip(new, packed(least).view(np.int64), bands(least).view(np.int64), strict=True):
                    bits[i], keys[i] = x, y
            yield shared.as_batch(["doc_id", "n", "sig", "bits", "bands"], [b.column(0), [len(s) for s in found], names, bits, keys], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())])

    return shared.arrow(docs, rows, "doc_id long, n long, sig long, bits array<long>, bands array<long>")


def join(docs: DataFrame, id_column: str = "doc_id", k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept (it is the row's own) of every row of docs."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = shared.written(sketches(docs, k))
    nodes = shared.kept(sketch.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id")))
    # a set that several tasks met has a row from each, all equal
    about = shared.kept(sketch.filter("bits is not null").select("sig", "n", "bits").dropDuplicates(["sig"]))
    n, m = F.col("n"), F.col("hub.n")
    fits = (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (similarity("bits", "hub.bits") >= LOOSE)
    lists = sketch.filter("bands is not null").select(F.explode("bands").alias("key"), "sig").distinct()
    comp = hubs.classes(lists, about, fits, lambda pairs: _linked(shared.kept(pairs), docs, nodes, k, percent))
    of = nodes.join(shared.dealt(comp).withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    least = of.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = of.join(shared.dealt(least), "comp").select("sig", "component_id")
    component = F.coalesce("component_id", "doc_id")
    return sketch.select("doc_id", "n", "sig").join(shared.dealt(named), "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
