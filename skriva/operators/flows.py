"""Capture analytics over decoded packets: conversations, hosts, protocols, names, failures.

Packets have file, seq, at_ns, bytes, kind ('ip', 'arp', or another, null if undecodable), src, dst, src_key,
dst_key (binary, ordered as addresses are), proto_ord, proto_num, src_port, dst_port, tcp_flags and query.
Every rollup is by file, partially aggregated before its shuffle; min and max don't depend on arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spoken import NS

#: Keys held, and keys told, by kind (fixed values).
HELD = {"conversations": 20_000, "hosts": 5_000, "queries": 2_000}
TOLD = {"conversations": 12, "hosts": 8, "queries": 15}
TCP, UDP, ICMP, OTHER = 0, 1, 2, 3
#: Protocols said by name (fixed values).
PROTOCOLS = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 89: "OSPF", 132: "SCTP"}
#: Services said by name (fixed values).
SERVICES = {
    "FTP": (20, 21), "SSH": (22,), "Telnet": (23,), "email being sent": (25, 465, 587), "DNS": (53,), "DHCP": (67, 68), "TFTP": (69,),
    "HTTP": (80, 8080), "email being collected": (110, 995), "network time": (123,), "IMAP": (143, 993), "SNMP": (161, 162),
    "LDAP": (389, 636), "HTTPS": (443, 8443), "Windows file sharing": (445,), "Apple file sharing": (548,), "printing": (631,),
    "DNS over TLS": (853,), "SQL Server": (1433,), "device discovery": (1900,), "MySQL": (3306,), "remote desktop": (3389,),
    "SIP": (5060, 5061), "Bonjour": (5353,), "PostgreSQL": (5432,), "Redis": (6379,), "MongoDB": (27017,),
}
_KEY = ["file", "low_addr", "low_port", "high_addr", "high_port", "proto_ord", "proto_num"]


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def protocol_name(num: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(PROTOCOLS), num), F.concat(F.lit("IP protocol "), num.cast("string")))


def service(low_port: Column, high_port: Column) -> Column:
    """The named port's service; if both are named, the lower port's."""
    name = _map({p: s for s, ports in SERVICES.items() for p in ports})
    a, b = F.try_element_at(name, F.least(low_port, high_port)), F.try_element_at(name, F.greatest(low_port, high_port))
    return F.coalesce(a, b)


def _directed(packets: DataFrame) -> DataFrame:
    src = F.struct(F.col("src_key").alias("key"), F.coalesce("src_port", F.lit(0)).alias("port"), F.col("src").alias("addr"))
    dst = F.struct(F.col("dst_key").alias("key"), F.coalesce("dst_port", F.lit(0)).alias("port"), F.col("dst").alias("addr"))
    ends = packets.filter("kind = 'ip'").withColumn("low", F.least(src, dst)).withColumn("high", F.greatest(src, dst))
    return ends.select("*", F.col("low.addr").alias("low_addr"), F.col("low.port").alias("low_port"), F.col("high.addr").alias("high_addr"), F.col("high.port").alias("high_port"), F.col("low.key").alias("low_key"), F.col("high.key").alias("high_key"))


def conversations(packets: DataFrame) -> DataFrame:
    """Both directions of two endpoints and a protocol as one row."""
    flag = lambda bits: (F.col("proto_ord") == TCP) & (F.coalesce("tcp_flags", F.lit(0)).bitwiseAND(bits) != 0)
    return _directed(packets).groupBy(*_KEY, "low_key", "high_key").agg(
        F.count("*").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.min("at_ns").alias("first_ns"),
        F.max("at_ns").alias("last_ns"),
        F.count_if(flag(2) & ~flag(16)).alias("opens"),
        F.count_if(flag(4)).alias("resets"),
        F.count_if(flag(1)).alias("finishes"),
        F.bool_or(flag(2) & flag(16)).alias("accepted"),
    )


#: The sentences are fixed text.
def verdict() -> Column:
    """What a TCP connection did, over a row of conversations(); empty for other protocols."""
    return F.expr("""CASE
        WHEN proto_ord <> 0 THEN ''
        WHEN resets > 0 AND NOT accepted THEN 'The connection was refused.'
        WHEN resets > 0 THEN 'The connection was cut off rather than closed.'
        WHEN opens > 0 AND NOT accepted THEN 'The connection was never answered.'
        WHEN finishes > 0 THEN 'It opened and closed normally.'
        WHEN accepted THEN 'It opened normally and was still open at the end.'
        ELSE 'It was already under way when the capture started.' END""")


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each file; the limit goes below the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(*order))).filter(F.col("rank") <= k)


def busiest(conv: DataFrame, k: int = TOLD["conversations"]) -> DataFrame:
    return _top(conv, k, F.desc("packets"), F.desc("bytes"), F.col("low_key"), F.col("low_port"), F.col("high_key"), F.col("high_port"), F.col("proto_ord"), F.col("proto_num"))


def hosts(packets: DataFrame) -> DataFrame:
    """Packets sent and received, and bytes sent, by address."""
    ip = packets.filter("kind = 'ip'")
    seen = ip.select("file", F.explode(F.array(F.struct(F.col("src").alias("addr"), F.col("src_key").alias("key"), F.lit(1).alias("s"), F.lit(0).alias("r"), F.col("bytes").alias("b")), F.struct(F.col("dst").alias("addr"), F.col("dst_key").alias("key"), F.lit(0).alias("s"), F.lit(1).alias("r"), F.lit(0).cast("long").alias("b")))).alias("x"))
    return seen.groupBy("file", F.col("x.addr").alias("addr"), F.col("x.key").alias("addr_key")).agg(F.sum("x.s").alias("sent"), F.sum("x.r").alias("received"), F.sum("x.b").alias("bytes_sent"))


def busiest_hosts(found: DataFrame, k: int = TOLD["hosts"]) -> DataFrame:
    return _top(found, k, F.desc(F.col("sent") + F.col("received")), F.col("addr_key"))


def queries(packets: DataFrame) -> DataFrame:
    return packets.filter("kind = 'ip' and query is not null").groupBy("file", "query").agg(F.count("*").alias("asked"))


def most_asked(found: DataFrame, k: int = TOLD["queries"]) -> DataFrame:
    return _top(found, k, F.desc("asked"), F.col("query"))


def protocol_share(packets: DataFrame) -> DataFrame:
    """Packets of each protocol, and their share of all IP packets in whole percent, ties to even."""
    n = packets.filter("kind = 'ip'").groupBy("file", "proto_ord", "proto_num").agg(F.count("*").alias("packets"))
    total = F.sum("packets").over(Window.partitionBy("file"))
    return n.withColumn("percent", F.bround(F.col("packets") / total * 100, 0).cast("long"))


def totals(packets: DataFrame) -> DataFrame:
    """Packets, bytes, time span (null without a clock), lookups of local addresses and what couldn't be decoded."""
    undecoded = F.col("kind").isNull() | ~F.col("kind").isin("ip", "arp")
    out = packets.groupBy("file").agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"), F.min("at_ns").alias("first_ns"), F.max("at_ns").alias("last_ns"), F.count_if(F.col("kind") == "arp").alias("arp"), F.count_if(undecoded).alias("undecoded"))
    return out.withColumn("duration_ns", F.col("last_ns") - F.col("first_ns"))


def trouble(conv: DataFrame) -> DataFrame:
    return conv.groupBy("file").agg(
        F.count_if((F.col("resets") > 0) & ~F.col("accepted")).alias("refused"),
        F.count_if((F.col("opens") > 0) & ~F.col("accepted") & (F.col("resets") == 0)).alias("unanswered"),
        F.count_if((F.col("resets") > 0) & F.col("accepted")).alias("reset"),
    )


def timing(conv: DataFrame, total: DataFrame) -> DataFrame:
    """Whole seconds from the capture's start to the conversation's, and of its length; null under one second."""
    joined = conv.join(total.select("file", F.col("first_ns").alias("capture_ns")), "file")
    within, lasted = F.col("first_ns") - F.col("capture_ns"), F.col("last_ns") - F.col("first_ns")
    gate = lambda c: F.when(c >= NS, F.floor(c / NS).cast("long"))
    return joined.withColumn("starts_in", gate(within)).withColumn("lasting", gate(lasted)).drop("capture_ns")


def capped(packets: DataFrame, held: dict[str, int] | None = None) -> DataFrame:
    """How many conversations, hosts and names bounded tables would hold, and what they'd turn away.

    A table admits keys in the order of their first packet. Turned away are packets for conversations, sightings
    (source before destination) for hosts, nothing for names. The rank is over keys, limited before the shuffle.
    """
    held = HELD | (held or {})
    directed = _directed(packets)
    conv = directed.groupBy(*_KEY).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    host = packets.filter("kind = 'ip'").select("file", F.explode(F.array(F.struct(F.col("src").alias("addr"), (F.col("seq") * 2).alias("at")), F.struct(F.col("dst").alias("addr"), (F.col("seq") * 2 + 1).alias("at")))).alias("x"))
    host = host.groupBy("file", "x.addr").agg(F.min("x.at").alias("first"), F.count("*").alias("n"))
    name = packets.filter("kind = 'ip' and query is not null").groupBy("file", "query").agg(F.min("seq").alias("first"), F.lit(0).cast("long").alias("n"))
    out = None
    for kind, keys in (("conversations", conv), ("hosts", host), ("queries", name)):
        inside = _top(keys, held[kind], F.col("first"))
        kept = inside.groupBy("file").agg(F.count("*").alias("held"), F.sum("n").alias("in"))
        every = keys.groupBy("file").agg(F.sum("n").alias("all"))
        part = every.join(kept, "file").select("file", F.lit(kind).alias("kind"), "held", (F.col("all") - F.col("in")).alias("overflow"))
        out = part if out is None else out.union(part)
    return out
