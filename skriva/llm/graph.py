"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt, kept, tidy


def components(links: DataFrame) -> DataFrame:
    """(node, comp): comp is the least node that links of (a, b) reach. Only nodes with links have rows.

    Each round takes the least label of the neighbours, then the label's own label, so paths shorten
    geometrically. A round ends in a checkpoint. No links: no rows.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b"), F.col("a"))).filter("node <> other").distinct()
    both = kept(both)
    labels = kept(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")))
    while True:
        seen = dealt(both).join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        best = dealt(labels).join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        new = kept(dealt(best).join(up, "comp").select("node", "old", F.least("comp", "above").alias("comp")))
        labels = new.select("node", "comp")
        if new.filter("old <> comp").isEmpty():
            del both, seen, best, up
            tidy(links.sparkSession)  # the rounds' shuffles, of which the driver keeps the places
            return labels
