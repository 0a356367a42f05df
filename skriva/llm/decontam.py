"""Benchmark decontamination with DataFrame functions only.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. The benchmark's windows of
WINDOW words (an item of fewer words is one window) are a broadcast hash set keyed by the window's text, so
a probe that finds its key has verified the hit. Documents' windows stream past it; only hits are shuffled.

Null text has no words; an item without words has no window; equal rows each get their row of the result. Ids
may be null or repeated: a row is known by its id and text. Texts of any length are probed whole. Items whose
windows are equal are all named. Other columns aren't read, and come back from remove() as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Windows, each counted once for each of its items, up to which the benchmark is broadcast (some 100 bytes each);
#: beyond, the join shuffles.
MOST_BROADCAST = 1_000_000
WORD, BREAK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: str) -> Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lower, f"{BREAK}+"), "")


def windows(column: str, size: Column) -> Column:
    """at (from 0), size and text (w) of each window of so many words."""
    at = F.when(F.size(column) >= size, F.sequence(F.lit(0), F.size(column) - size)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), size.alias("size"), F.array_join(F.slice(column, i + 1, size), " ").alias("w")))


def benchmark_windows(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """w, size and item_ids (as strings) of each distinct window."""
    split = items.select(F.col(id_column).cast("string").alias("item"), words(text).alias("words"))
    n = F.size("words")
    long = split.filter(n >= WINDOW).select("item", F.inline(windows("words", F.lit(WINDOW)))).select("item", "w", "size")
    short = split.filter((n > 0) & (n < WINDOW)).select("item", F.array_join("words", " ").alias("w"), n.alias("size"))
    return long.union(short).groupBy("w", "size").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document with a hit: its id, the hash of its text, n_hit, items and the covered spans.

    At scale: documents are read once for all sizes and no text is shuffled; the rows that leave the scan are
    hits. The one action is a count of windows and their items by size, which has WINDOW rows at most.
    """
    known = benchmark_windows(items)
    sizes = {r["size"]: r["n"] for r in known.groupBy("size").agg(F.sum(F.size("items")).alias("n")).collect()}
    split = docs.select(F.col(id_column).alias("__id"), F.xxhash64(text).alias("__h"), words(text).alias("__words"))
    set_of = F.broadcast(known) if sum(sizes.values()) <= MOST_BROADCAST else known
    each = split.select("*", F.explode(F.array(*map(F.lit, sorted(sizes) or [WINDOW]))).alias("__size"))
    probe = each.select("__id", "__h", F.inline(windows("__words", F.col("__size"))))
    found = probe.join(set_of, ["w", "size"]).select("__id", "__h", "at", "size", "items")
    merged = found.groupBy("__id", "__h").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    union = F.aggregate("spans", start, lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(a["end"], s["at"]))).alias("n")))
    return merged.select("__id", "__h", "spans", F.sort_array("items").alias("items"), union["n"].cast("long").alias("n_hit"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    found = hits(docs, items).select("__id", "__h", "n_hit", "items")
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("__k"), F.size(words("text")).cast("long").alias("n_words"))
    joined = all_docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__h")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(docs: DataFrame, items: DataFrame, mode: str = "document", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the hit documents, or ("span") without their hit words and what stands before each."""
    found = hits(docs, items, id_column, text)
    same = F.col(id_column).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__h"))
    if mode == "document":
        return docs.join(found.select("__id", "__h"), same, "left_anti")
    if mode != "span":
        raise ValueError("mode is document or span")
    # the text keeps its case here, so its capitals are letters and no breaks
    gap, letter = BREAK.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"), WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    parts = F.regexp_extract_all(F.col(text), F.lit(f"{gap}*{letter}+"), F.lit(0))
    inside = lambda i: F.exists("__spans", lambda s: (i >= s["at"]) & (i < s["at"] + s["size"]))
    left = F.filter(F.transform(parts, lambda p, i: F.when(~inside(i), p)), lambda p: p.isNotNull())
    tail = F.regexp_extract(F.col(text), f"{gap}*\\z", 0)
    cut = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.concat(F.array_join(left, ""), tail))
    joined = docs.join(found.select("__id", "__h", F.col("spans").alias("__spans")), same, "left")
    return joined.select(*[cut.alias(text) if c == text else F.col(c) for c in docs.columns])
