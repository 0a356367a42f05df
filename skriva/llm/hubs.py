"""Classes of nodes that share lists, without the pairs of a list.

Instead of all pairs of a list, some members are its hubs and are tested against the others: first the least, then, as
node names are hashes, those below 16 / m of their range in a list of m, below 272 / m, and so on. A pair whose nodes are
in one class already isn't tested. A list is done when its members are in one class or each was tested against each, so
every link between nodes that share a list is found or implied by others. Lists are joined by key with both sides
shuffled for it, so that Spark may split a long one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .graph import components


def classes(lists: DataFrame, about: DataFrame, fits: Column, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, comp) of the nodes that have links.

    lists: key and sig, each pair once. about: a row for each sig with what fits needs, a condition on it and on hub.*;
    pairs that don't fit leave no join. linked: which pairs of (a, b) link.
    """
    lists = shared.kept(lists)
    long = shared.kept(lists.groupBy("key").agg(F.min("sig").alias("least"), F.count("*").alias("m")).filter("m > 1"))
    lists = shared.kept(lists.join(shared.dealt(long), "key").join(shared.dealt(about), "sig"))
    hub = F.struct("sig", *(c for c in about.columns if c != "sig")).alias("hub")
    pair = [F.col("hub.sig").alias("a"), F.col("sig").alias("b")]
    comp = components(linked(lists.join(shared.dealt(lists.filter("sig = least").select("key", hub)), "key").filter((F.col("sig") != F.col("hub.sig")) & fits).select(*pair).distinct()))
    lists = lists.filter("m > 2").drop("least")
    columns = lists.columns
    at, more, last = 0, 16, None
    while True:
        named = lists.join(shared.dealt(comp).withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        split = shared.kept(named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("m").alias("m")).filter(f"low <> high and m > {at}").select("key"))
        lists = shared.kept(named.join(shared.dealt(split), "key", "left_semi"))
        if last is not None:
            shared.drop(last)
        last = lists
        if lists.isEmpty():
            return comp
        place = F.expr("(cast(sig as double) / 18446744073709551616D + 0.5D) * m")
        hubs = lists.filter((place >= at) & (place < at + more)).select("key", hub, F.col("comp").alias("of"))
        pairs = lists.join(shared.dealt(hubs), "key").filter((F.col("comp") != F.col("of")) & (F.col("sig") > F.col("hub.sig")) & fits).select(*pair)
        found = linked(pairs.distinct())
        name = lambda df, c: df.join(shared.dealt(comp).select(F.col("node").alias(c), F.col("comp").alias(f"of_{c}")), c, "left").withColumn(c, F.coalesce(f"of_{c}", c)).drop(f"of_{c}")
        found = shared.kept(name(name(found, "a"), "b").distinct())
        if not found.isEmpty():
            merged = components(found).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
            alone = found.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("comp"))
            old = comp.union(alone).distinct()
            comp = shared.kept(old.join(shared.dealt(merged), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")).groupBy("node").agg(F.min("comp").alias("comp")))
        at, more = at + more, more * 16
        shared.tidy(lists.sparkSession)
        lists = lists.select(*columns)
