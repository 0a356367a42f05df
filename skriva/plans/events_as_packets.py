"""The driver's events read as decoded packets, natively and as SQL, so that capture analytics have an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One expression per column, valid in Spark SQL and DuckDB alike; u, t: user and number of the event's type.
_NUMBERS = """
    SELECT 'events' AS file, event_id AS seq, {micros} * 1000 AS at_ns, CAST(60 + floor(value * 10) AS BIGINT) AS bytes, event_id AS e,
           user_id AS u, (length(event_type) + user_id) % 5 AS t
    FROM events"""
_ROLES = """
    SELECT file, seq, at_ns, bytes, e, CASE WHEN e % 37 = 0 THEN 'arp' WHEN e % 41 = 0 THEN 'other' ELSE 'ip' END AS kind,
           CASE WHEN e % 10 < 6 THEN 0 WHEN e % 10 < 9 THEN 1 ELSE 2 END AS proto_ord,
           CASE WHEN e % 10 < 6 THEN 6 WHEN e % 10 < 9 THEN 17 ELSE 1 END AS proto_num,
           167772160 + u AS client, 3232235777 + t AS server, 1024 + u % 50000 AS client_port,
           CASE t WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 22 ELSE 9999 END AS server_port,
           CASE e % 7 WHEN 0 THEN 2 WHEN 1 THEN 18 WHEN 2 THEN 4 WHEN 3 THEN 17 ELSE 16 END AS flags, e % 3 = 1 AS back, u
    FROM ({numbers}) AS numbers"""
_PACKETS = """
    SELECT file, seq, at_ns, bytes, kind, proto_ord, proto_num,
           CASE WHEN back THEN server ELSE client END AS src_num, CASE WHEN back THEN client ELSE server END AS dst_num,
           CASE WHEN proto_ord = 2 THEN 0 WHEN back THEN server_port ELSE client_port END AS src_port,
           CASE WHEN proto_ord = 2 THEN 0 WHEN back THEN client_port ELSE server_port END AS dst_port,
           CASE WHEN proto_ord = 0 THEN flags ELSE 0 END AS tcp_flags,
           CASE WHEN kind = 'ip' AND proto_ord = 1 AND server_port = 53 AND NOT back THEN concat('host', CAST(u % 20 AS {text}), '.example.com') END AS query
    FROM ({roles}) AS roles"""


def sql(micros: str, text: str) -> str:
    numbers = _NUMBERS.format(micros=micros)
    return _PACKETS.format(roles=_ROLES.format(numbers=numbers), text=text)


#: For DuckDB.
ORACLE = sql("epoch_us(ts)", "VARCHAR")


def duck_address(n: str) -> str:
    return f"concat(({n} >> 24)::VARCHAR, '.', (({n} >> 16) & 255)::VARCHAR, '.', (({n} >> 8) & 255)::VARCHAR, '.', ({n} & 255)::VARCHAR)"


def packets(spark, sf_dir: str) -> DataFrame:
    """Decoded packets with addresses as text and as ordered keys."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.sql(sql("unix_micros(CAST(ts AS TIMESTAMP))", "STRING").replace("FROM events)", "FROM {events})"), events=events)
    byte = lambda c, s: F.shiftright(F.col(c), s).bitwiseAND(255)
    address = lambda c: F.concat_ws(".", *[byte(c, s).cast("string") for s in (24, 16, 8, 0)])
    key = lambda c: F.unhex(F.concat(F.lit("04"), F.lpad(F.hex(c), 8, "0")))
    made = rows.select("file", "seq", "at_ns", "bytes", "kind", "proto_ord", "proto_num", "src_port", "dst_port", "tcp_flags", "query", *[F.col(c).cast("long").alias(c) for c in ("src_num", "dst_num")])
    return made.select("*", address("src_num").alias("src"), address("dst_num").alias("dst"), key("src_num").alias("src_key"), key("dst_num").alias("dst_key"))
