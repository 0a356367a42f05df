"""Extension: capture rollups over a stream of decoded packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.flows import conversations


def streaming_conversations(packets: DataFrame) -> DataFrame:
    """conversations() of a stream, for update mode. Its aggregates don't depend on order; its state grows with the
    number of conversations, so use windowed_conversations() where that has no bound."""
    return conversations(packets)


def windowed_conversations(packets: DataFrame, length: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Packets and bytes by window and pair of endpoints, late packets within a watermark; state is bounded by it."""
    timed = packets.filter("kind = 'ip' and at_ns is not null").withColumn("at", F.timestamp_micros(F.floor(F.col("at_ns") / 1000).cast("long"))).withWatermark("at", late)
    src, dst = (F.struct(F.col(f"{x}_key").alias("key"), F.col(x).alias("addr")) for x in ("src", "dst"))
    low, high = F.least(src, dst), F.greatest(src, dst)
    grouped = timed.groupBy(F.window("at", length), low["addr"].alias("low_addr"), high["addr"].alias("high_addr"), "proto_num")
    return grouped.agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"))
