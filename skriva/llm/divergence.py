"""Source divergence audit: how far the word shares of each (lang, source) group lie from those of its language's other sources.

A term's share in a group is smoothed: p = 1 + floor(10^9 (count + 5) / (N + 5 V)), with the group's N occurrences
of the V terms that its language keeps (those in LEAST documents or more). The distance of two groups is
the sum of |p - q| over all V terms. Most counts are zero, so a pair starts from the baseline, V |p0 - q0| with the
shares p0 and q0 of a count of zero, and an inverted index (term to the groups that hold it, with counts) gives the
corrections only:

    of a term that a alone holds  |p - q0| - |p0 - q0|
    of one that both hold         that of each alone, and |p - q| - |p - q0| - |p0 - q| + |p0 - q0| more

What a group's terms correct alone depends on the other group by its q0 only; so these sums are read for all the other
groups at once from running sums over the group's shares in order. What two groups share is summed by a task over the
postings that it has, term by term, and leaves it as one row for a pair.

Null text, lang and source count as ''. A group without kept terms has p0 for every term; a language with V = 0 has
only distances of 0. Every row is a document, so equal rows count as often as they come, and ids aren't read. Texts of
any length are counted whole. Equal values rank by item in the order of UTF-8 bytes. An empty table gives no rows.
Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

LEAST, SMOOTH, ONE, TOLD = 30, 5, 1_000_000_000, 50
#: Counts that a task holds before it adds them up, and sums that it holds before it sends them on.
HELD, SUMS = 1 << 20, 1 << 21
#: Groups up to which their totals are broadcast (some 100 bytes each); beyond, they and the index are shuffled.
MOST_BROADCAST = 50_000
#: Every ASCII byte that is no letter parts terms.
BREAKS = np.ones(256, bool)
BREAKS[65:91] = BREAKS[97:123] = BREAKS[128:] = False
_COUNTS = "lang string, source string, term string, n long, docs long"


def taken(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings at these places."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(starts - off[:-1], size) + np.arange(off[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs of every term, in parts: a task adds up what it has read before it sends it."""

    def add(parts: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(parts).combine_chunks().group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return summed.rename_columns(["lang", "source", "term", "n", "docs"]).cast(_SCHEMA)

    def rows(batches):
        parts, held = [], 0
        for b, buf, off in shared.pieces(batches):
            starts, ends, per_row = shared.spans(buf, off, BREAKS)
            if not len(starts):
                continue
            lang, source = (pc.fill_null(b.column(i), "") for i in range(2))
            groups = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
            names: dict[tuple, int] = {}
            of = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()], np.int64)
            row = np.repeat(np.arange(b.num_rows), per_row)
            low = shared.LOWER[buf]
            key = shared.mix(shared.hashes(low, starts, ends) ^ shared.mix(of[row].astype(np.uint64) + np.uint64(1)))
            order = np.argsort(key, kind="stable")  # rows stay in order within a key
            key, row = key[order], row[order]
            new = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(new)
            fresh = new | np.append(True, row[1:] != row[:-1])
            first = order[begin]
            terms = taken(low, starts[first], ends[first])
            group = pa.array(of[row[begin]])
            parts.append(pa.Table.from_arrays([*(pa.array([n[i] for n in names], pa.string()).take(group) for i in range(2)), terms, pa.array(np.diff(np.append(begin, len(key)))), pa.array(np.add.reduceat(fresh.astype(np.int64), begin))], schema=_SCHEMA))
            held += len(begin)
            if held > HELD:
                parts, held = [add(parts)], 0
                if parts[0].num_rows > HELD // 2:
                    yield from parts.pop().to_batches(1 << 14)
                else:
                    held = parts[0].num_rows
        if parts:
            yield from add(parts).to_batches(1 << 14)

    return shared.arrow(docs.select(*(F.col(c).cast("string") for c in ("lang", "source", "text"))), rows, _COUNTS)


_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def share(count: Column, total: Column, kept: Column) -> Column:
    """p, exact for counts of any size: the product is a decimal."""
    product = (count + SMOOTH).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)")
    return F.call_function("div", product, (total + SMOOTH * kept).cast("decimal(20,0)")) + 1


def postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The inverted index of the kept terms: lang, term, source, n there (over 0) and of_lang, n in the whole language."""
    # one shuffle for all three steps: a term's rows of all sources are few after the tasks' own sums
    each = counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    total = each.withColumn("of_lang", F.sum("n").over(of)).withColumn("docs", F.sum("docs").over(of))
    return total.filter(F.col("docs") >= least).select("lang", "term", "source", "n", "of_lang")


def shared_corrections(index: DataFrame) -> DataFrame:
    """lang, a < b (sources) and v: what the terms that both hold correct beyond each alone.

    index: lang, term, source, p and p0, sorted by lang, term and source within partitions that have terms whole. A task
    holds one term's postings, of one row for a source, and at most SUMS sums.
    """

    def rows(batches):
        names: dict[tuple, int] = {}
        keys, values, held, rest = [], [], 0, None

        def add():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            out = np.zeros(len(key), np.int64)
            np.add.at(out, at, np.concatenate(values))
            return key, out

        def sent(key, value):
            by = list(names)
            for i in range(0, len(key), 1 << 14):
                part = key[i : i + (1 << 14)]
                a, b = [by[k] for k in (part >> 32).tolist()], [by[k] for k in (part & 0xFFFFFFFF).tolist()]
                yield shared.as_batch(["lang", "a", "b", "v"], [[x[0] for x in a], [x[1] for x in a], [x[1] for x in b], value[i : i + (1 << 14)]], [pa.string()] * 3 + [pa.int64()])

        def corrections(whole: pa.Table):
            """(key, value) arrays of the terms in whole, blocks of equal lengths at once."""
            lang, term, source = (whole.column(c).to_pylist() for c in ("lang", "term", "source"))
            code = np.fromiter((names.setdefault(x, len(names)) for x in zip(lang, source, strict=True)), np.int64, len(lang))
            p, p0 = (whole.column(c).to_numpy() for c in ("p", "p0"))
            begin = np.flatnonzero([i == 0 or term[i] != term[i - 1] or lang[i] != lang[i - 1] for i in range(len(term))])
            size = np.diff(np.append(begin, len(term)))
            for m in np.unique(size[size > 1]).tolist():
                at = begin[size == m]
                for i in range(m - 1):  # the i-th posting with all later ones
                    step = max(1, (1 << 18) // (m - i))
                    for j in range(0, len(at), step):
                        one, others = at[j : j + step, None] + i, at[j : j + step, None] + np.arange(i + 1, m)
                        v = abs(p[one] - p[others]) - abs(p[one] - p0[others]) - abs(p0[one] - p[others]) + abs(p0[one] - p0[others])
                        key = (code[one] << 32) + code[others]
                        some = v != 0
                        yield key[some], v[some]

        def summed(whole):
            nonlocal keys, values, held
            for k, v in corrections(whole):
                keys.append(k)
                values.append(v)
                held += len(k)
                if held > SUMS:
                    k, v = add()
                    if len(k) > SUMS // 2:
                        yield from sent(k, v)
                        keys, values, held = [], [], 0
                    else:
                        keys, values, held = [k], [v], len(k)

        for b in batches:
            if not b.num_rows:
                continue
            rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            last = pc.and_(pc.equal(rest.column("term"), rest.column("term")[-1]), pc.equal(rest.column("lang"), rest.column("lang")[-1]))
            cut = rest.num_rows - pc.sum(last).as_py()
            if cut:
                yield from summed(rest.slice(0, cut).combine_chunks())
                rest = rest.slice(cut)
        if rest is not None:
            yield from summed(rest.combine_chunks())
        if keys:
            yield from sent(*add())

    each = shared.arrow(index.select("lang", "term", "source", "p", "p0"), rows, "lang string, a string, b string, v long")
    return each.groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))


def report(docs: DataFrame, least: int = LEAST, told: int = TOLD) -> DataFrame:
    """lang, source, part, item, value and rank: each group's distance from its language's other sources ("pair"), and its terms above the language's share ("term")."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    index = shared.written(postings(docs.select(blank("lang"), blank("source"), "text"), least))
    langs = index.select("lang", "term", "of_lang").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total"))
    totals = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(blank("lang"), blank("source")).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    groups = shared.kept(groups.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))))
    # the index's files are small for its rows, so Spark, which goes by the files' size, would broadcast it instead of the groups
    few = groups.count() <= MOST_BROADCAST
    posted = index.join(F.broadcast(groups) if few else groups.hint("merge"), ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("of_lang"), F.col("lang_total"), F.col("terms")).alias("q"), "p0")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = posted.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= told)

    both = shared_corrections(posted.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "p0", "terms").join(other, "lang").filter("source <> item")
    # a group's shares and the other groups' q0 in one order: the running sums at a q0 are those of the shares up to it
    bins = posted.groupBy("lang", "source", F.col("p").alias("x")).agg(F.count("*").alias("k"), F.sum("p").alias("s")).withColumn("item", F.lit(None).cast("string"))
    line = bins.unionByName(pairs.select("lang", "source", F.col("q0").alias("x"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("s"), "item").filter("x is not null"))
    of = Window.partitionBy("lang", "source")
    upto = of.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    sums = line.select("lang", "source", "item", "x", F.sum("k").over(upto).alias("k"), F.sum("s").over(upto).alias("s")).filter("item is not null")
    whole = bins.groupBy("lang", "source").agg(F.sum("k").alias("all_k"), F.sum("s").alias("all_s"))
    zero = F.lit(0).cast("long")
    far = F.col("x") * F.col("k") - F.col("s") + (F.coalesce("all_s", zero) - F.col("s")) - F.col("x") * (F.coalesce("all_k", zero) - F.col("k"))
    alone = sums.join(whole, ["lang", "source"], "left").select("lang", "source", "item", (far).alias("far"), F.coalesce("all_k", zero).alias("held"))
    one = alone.select("lang", "source", "item", "far", "held")
    two = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("far").alias("far_2"), F.col("held").alias("held_2"))
    met = pairs.join(one, ["lang", "source", "item"], "left").join(two, ["lang", "source", "item"], "left")
    met = met.withColumn("a", F.least("source", "item")).withColumn("b", F.greatest("source", "item")).join(both, ["lang", "a", "b"], "left")
    base = F.abs(F.col("p0") - F.col("q0"))
    value = base * F.col("terms") + F.col("far") - F.col("held") * base + F.col("far_2") - F.col("held_2") * base + F.coalesce("v", zero)
    far_apart = met.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(value, zero).alias("value"))
    out = far_apart.withColumn("rank", F.row_number().over(order)).unionByName(terms)
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
