"""Queries over the driver's tables, one or more for each operator, with the same rows as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spoken, text
from ..functions.arrow import spread
from ..operators import flows, frame_chain, sequences
from .events_as_packets import ORACLE as PACKETS
from .events_as_packets import duck_address, packets
from .registry import QUERIES, SQL, query, shared_folder, written
from .registry import read as _read

# --- captures -------------------------------------------------------------------------------------------------------

_CONV = f"""
SELECT file, {duck_address('low')} AS low_addr, lp AS low_port, {duck_address('high')} AS high_addr, hp AS high_port, low, high, proto_ord, proto_num,
       count(*) AS packets, sum(bytes)::BIGINT AS bytes, min(at_ns) AS first_ns, max(at_ns) AS last_ns,
       count(*) FILTER (proto_ord = 0 AND tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0) AS opens, count(*) FILTER (proto_ord = 0 AND tcp_flags & 4 <> 0) AS resets,
       count(*) FILTER (proto_ord = 0 AND tcp_flags & 1 <> 0) AS finishes, bool_or(proto_ord = 0 AND tcp_flags & 2 <> 0 AND tcp_flags & 16 <> 0) AS accepted
FROM (SELECT *, CASE WHEN (src_num, src_port) <= (dst_num, dst_port) THEN src_num ELSE dst_num END AS low, CASE WHEN (src_num, src_port) <= (dst_num, dst_port) THEN src_port ELSE dst_port END AS lp,
             CASE WHEN (src_num, src_port) <= (dst_num, dst_port) THEN dst_num ELSE src_num END AS high, CASE WHEN (src_num, src_port) <= (dst_num, dst_port) THEN dst_port ELSE src_port END AS hp
      FROM ({PACKETS}) AS p WHERE kind = 'ip') AS d
GROUP BY file, low, lp, high, hp, proto_ord, proto_num"""
_KEYS = "low_addr, low_port::BIGINT AS low_port, high_addr, high_port::BIGINT AS high_port, proto_num::BIGINT AS proto_num"
_WIDE = ["low_addr", "cast(low_port as bigint) as low_port", "high_addr", "cast(high_port as bigint) as high_port", "cast(proto_num as bigint) as proto_num"]


def _wide():
    return [F.expr(x) for x in _WIDE]


_VERDICT = """CASE WHEN proto_ord <> 0 THEN '' WHEN resets > 0 AND NOT accepted THEN 'The connection was refused.' WHEN resets > 0 THEN 'The connection was cut off rather than closed.'
 WHEN opens > 0 AND NOT accepted THEN 'The connection was never answered.' WHEN finishes > 0 THEN 'It opened and closed normally.'
 WHEN accepted THEN 'It opened normally and was still open at the end.' ELSE 'It was already under way when the capture started.' END"""


@query(f"SELECT {_KEYS}, packets, bytes, first_ns, last_ns, opens, resets, finishes, accepted FROM ({_CONV})")
def flow_conversations(spark, sf_dir):
    return flows.conversations(packets(spark, sf_dir)).select(*_wide(), "packets", "bytes", "first_ns", "last_ns", "opens", "resets", "finishes", "accepted")


@query(f"SELECT {_KEYS}, packets, bytes, row_number() OVER (ORDER BY packets DESC, bytes DESC, low, low_port, high, high_port, proto_ord, proto_num) AS rank FROM ({_CONV}) QUALIFY rank <= 12")
def flow_top12(spark, sf_dir):
    return flows.busiest(flows.conversations(packets(spark, sf_dir))).select(*_wide(), "packets", "bytes", F.col("rank").cast("long"))


#: What the operator is held against (fixed values, in full).
_NAMED = """(20, 'FTP'), (21, 'FTP'), (22, 'SSH'), (23, 'Telnet'), (25, 'email being sent'), (465, 'email being sent'), (587, 'email being sent'), (53, 'DNS'), (67, 'DHCP'), (68, 'DHCP'), (69, 'TFTP'), (80, 'HTTP'), (8080, 'HTTP'), (110, 'email being collected'), (995, 'email being collected'), (123, 'network time'), (143, 'IMAP'), (993, 'IMAP'), (161, 'SNMP'), (162, 'SNMP'), (389, 'LDAP'), (636, 'LDAP'), (443, 'HTTPS'), (8443, 'HTTPS'), (445, 'Windows file sharing'), (548, 'Apple file sharing'), (631, 'printing'), (853, 'DNS over TLS'), (1433, 'SQL Server'), (1900, 'device discovery'), (3306, 'MySQL'), (3389, 'remote desktop'), (5060, 'SIP'), (5061, 'SIP'), (5353, 'Bonjour'), (5432, 'PostgreSQL'), (6379, 'Redis'), (27017, 'MongoDB')"""


@query(
    f"WITH n(port, name) AS (VALUES {_NAMED}) SELECT {_KEYS}, {_VERDICT} AS verdict, coalesce(a.name, b.name) AS service, CASE proto_num WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS protocol"
    f" FROM ({_CONV}) AS c LEFT JOIN n AS a ON a.port = least(low_port, high_port) LEFT JOIN n AS b ON b.port = greatest(low_port, high_port)"
)
def flow_verdicts(spark, sf_dir):
    conv = flows.conversations(packets(spark, sf_dir))
    return conv.select(*_wide(), flows.verdict().alias("verdict"), flows.service(F.col("low_port"), F.col("high_port")).alias("service"), flows.protocol_name(F.col("proto_num")).alias("protocol"))


_HOSTS = f"SELECT n, sum(s)::BIGINT AS sent, sum(r)::BIGINT AS received, sum(b)::BIGINT AS bytes_sent FROM (SELECT src_num AS n, 1 AS s, 0 AS r, bytes AS b FROM ({PACKETS}) AS p WHERE kind = 'ip' UNION ALL SELECT dst_num, 0, 1, 0 FROM ({PACKETS}) AS p WHERE kind = 'ip') AS x GROUP BY n"


@query(f"SELECT {duck_address('n')} AS addr, sent, received, bytes_sent, row_number() OVER (ORDER BY sent + received DESC, n) AS rank FROM ({_HOSTS}) QUALIFY rank <= 8")
def flow_hosts_top8(spark, sf_dir):
    return flows.busiest_hosts(flows.hosts(packets(spark, sf_dir))).select("addr", "sent", "received", "bytes_sent", F.col("rank").cast("long"))


@query(f"SELECT query, count(*) AS asked, row_number() OVER (ORDER BY count(*) DESC, query) AS rank FROM ({PACKETS}) AS p WHERE kind = 'ip' AND query IS NOT NULL GROUP BY query QUALIFY rank <= 15")
def flow_names_top15(spark, sf_dir):
    return flows.most_asked(flows.queries(packets(spark, sf_dir))).select("query", "asked", F.col("rank").cast("long"))


@query(f"SELECT proto_num::BIGINT AS proto_num, count(*) AS packets, round_even(count(*) / sum(count(*)) OVER () * 100, 0)::BIGINT AS percent FROM ({PACKETS}) AS p WHERE kind = 'ip' GROUP BY proto_num")
def flow_protocol_share(spark, sf_dir):
    return flows.protocol_share(packets(spark, sf_dir)).select(F.col("proto_num").cast("long"), "packets", "percent")


@query(f"SELECT count(*) AS packets, sum(bytes)::BIGINT AS bytes, min(at_ns) AS first_ns, max(at_ns) AS last_ns, count(*) FILTER (kind = 'arp') AS arp, count(*) FILTER (kind NOT IN ('ip', 'arp')) AS undecoded, max(at_ns) - min(at_ns) AS duration_ns FROM ({PACKETS}) AS p")
def flow_totals(spark, sf_dir):
    return flows.totals(packets(spark, sf_dir)).drop("file")


@query(f"SELECT count(*) FILTER (resets > 0 AND NOT accepted) AS refused, count(*) FILTER (opens > 0 AND NOT accepted AND resets = 0) AS unanswered, count(*) FILTER (resets > 0 AND accepted) AS reset FROM ({_CONV})")
def flow_trouble(spark, sf_dir):
    return flows.trouble(flows.conversations(packets(spark, sf_dir))).drop("file")


@query(f"SELECT {_KEYS}, CASE WHEN first_ns - (SELECT min(at_ns) FROM ({PACKETS}) AS p) >= 1000000000 THEN (first_ns - (SELECT min(at_ns) FROM ({PACKETS}) AS p)) // 1000000000 END AS starts_in, CASE WHEN last_ns - first_ns >= 1000000000 THEN (last_ns - first_ns) // 1000000000 END AS lasting FROM ({_CONV})")
def flow_timing(spark, sf_dir):
    p = packets(spark, sf_dir)
    return flows.timing(flows.conversations(p), flows.totals(p)).select(*_wide(), "starts_in", "lasting")


_CAP = {"conversations": 100, "hosts": 60, "queries": 5}


def _capped_sql() -> str:
    conv = f"SELECT concat(least((src_num, src_port), (dst_num, dst_port))::VARCHAR, greatest((src_num, src_port), (dst_num, dst_port))::VARCHAR, proto_num::VARCHAR) AS k, seq * 2 AS pos, 1 AS n FROM ({PACKETS}) AS p WHERE kind = 'ip'"
    host = f"SELECT src_num::VARCHAR AS k, seq * 2 AS pos, 1 AS n FROM ({PACKETS}) AS p WHERE kind = 'ip' UNION ALL SELECT dst_num::VARCHAR, seq * 2 + 1, 1 FROM ({PACKETS}) AS p WHERE kind = 'ip'"
    name = f"SELECT query AS k, seq * 2 AS pos, 0 AS n FROM ({PACKETS}) AS p WHERE kind = 'ip' AND query IS NOT NULL"
    part = "SELECT '{kind}' AS kind, count(*) FILTER (r <= {cap}) AS held, coalesce(sum(n) FILTER (r > {cap}), 0)::BIGINT AS overflow FROM (SELECT k, sum(n) AS n, row_number() OVER (ORDER BY min(pos)) AS r FROM ({rows}) AS x GROUP BY k) AS y"
    return " UNION ALL ".join(part.format(kind=k, cap=_CAP[k], rows=r) for k, r in (("conversations", conv), ("hosts", host), ("queries", name)))


@query(_capped_sql())
def flow_capped(spark, sf_dir):
    return flows.capped(packets(spark, sf_dir), _CAP).drop("file")


@query(_capped_sql())
def flow_capped_stream(spark, sf_dir):
    """The same from a stream over the packets as files, in four batches that hold them in no order."""
    from ..streaming.bounded import capped_stream

    where = shared_folder(spark)
    rows = packets(spark, sf_dir)
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # of a batch: what its tasks read
    rows.repartition(4 * files, F.xxhash64("seq")).write.parquet(f"{where}/in")
    reach = rows.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]  # any packet may come last
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{where}/in")

    def keep(batch, epoch):
        batch.withColumn("batch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{where}/out/{epoch}")  # the same, where a batch runs again

    q = capped_stream(stream, _CAP, reach).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("file string, kind string, held long, overflow long, settled boolean, batch long").parquet(f"{where}/out/*")
    return out.groupBy("file", "kind").agg(F.max_by(F.struct("held", "overflow"), "batch").alias("x")).select("kind", "x.held", "x.overflow")


# --- text -----------------------------------------------------------------------------------------------------------

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f\x0b\x{{A0}}]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+', ''), '{_WS}+$', '') AS tidied FROM documents""")
def text_tidy(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.tidy("text").alias("tidied"))


_RULES = [text.Rule("the", "a"), text.Rule("of", "from"), text.Rule("der", "jener")]
_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+')"


def _replaced(rules) -> str:
    case = "x"
    for r in rules:
        case = f"CASE WHEN lower({case}) = '{r.find}' THEN CASE WHEN upper({case}[1]) = {case}[1] THEN '{r.to[:1].upper() + r.to[1:]}' ELSE '{r.to}' END ELSE {case} END"
    return case


@query(f"SELECT doc_id, array_to_string(list_transform({_TOKENS}, lambda x: {_replaced(_RULES)}), '') AS said, len(list_filter({_TOKENS}, lambda x: lower(x) IN ('the', 'of', 'der')))::BIGINT AS made FROM documents")
def text_replace(spark, sf_dir):
    said, made = text.replace("text", _RULES)
    return _read(spark, sf_dir, "documents").select("doc_id", said.alias("said"), made.alias("made"))


_UNITS = r"""list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?。！？\n])([ \t\n\r]+)', '\1\2' || chr(1), 'g'), '([.!?。！？\n])(["''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda u: u <> '')"""


@query(f"SELECT doc_id, len(u)::BIGINT AS n_units, md5(array_to_string(u, chr(1))) AS units FROM (SELECT doc_id, {_UNITS} AS u FROM documents)")
def text_units(spark, sf_dir):
    u = text.units("text")
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(u).cast("long").alias("n_units"), F.md5(F.array_join(u, "\x01").cast("binary")).alias("units"))


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _chunked(most: int) -> str:
    """Units, and the words of those that are too long (between nulls, which close a chunk), folded into chunks."""
    word = _WS.replace("[", "[^", 1)
    words = f"flatten(list_transform(regexp_extract_all(u, '{word}*{_WS}|{word}+$'), lambda w: CASE WHEN length(w) <= {most} THEN [w] ELSE list_transform(range(1, length(w) + 1, {most}), lambda i: substr(w, i, {most})) END))"
    items = f"flatten(list_transform(u, lambda u: CASE WHEN length(u) <= {most} THEN [u] ELSE list_concat([NULL], {words}, [NULL]) END))"
    close = f"CASE WHEN {_strip('acc.now')} <> '' THEN list_append(acc.out, {_strip('acc.now')}) ELSE acc.out END"
    step = f"CASE WHEN e.now IS NOT NULL AND length(acc.now) + length(e.now) <= {most} THEN {{'out': acc.out, 'now': acc.now || e.now}} ELSE {{'out': {close}, 'now': coalesce(e.now, '')}} END"
    folded = f"list_reduce(list_transform({items}, lambda x: {{'out': []::VARCHAR[], 'now': x}}), lambda acc, e: {step}, {{'out': []::VARCHAR[], 'now': ''}})"
    return f"SELECT doc_id, {close} AS c FROM (SELECT doc_id, {folded} AS acc FROM (SELECT doc_id, {_UNITS} AS u FROM documents))"


@query(f"SELECT doc_id, i::BIGINT - 1 AS chunk_no, c[i] AS chunk, CASE WHEN i > 1 THEN right(c[i - 1], 300) END AS prev, left(c[i + 1], 300) AS next FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM ({_chunked(4500)}))")
def text_chunks(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(text.with_neighbours(text.chunks("text"))).alias("x")).select("doc_id", F.col("x.chunk_no").cast("long").alias("chunk_no"), "x.chunk", "x.prev", "x.next")


@query(f"SELECT doc_id, i::BIGINT - 1 AS chunk_no, c[i] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM ({_chunked(80)}))")
def text_chunks_hard(spark, sf_dir):
    """Chunks of 80 characters, where most units are cut word by word."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunks("text", 80)).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query(r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(line, 'sk_[A-Za-z0-9_-]{8,}|s|[^s]+'), lambda x: CASE WHEN regexp_full_match(x, 'sk_[A-Za-z0-9_-]{8,}') THEN '[redacted ' || length(x) || ' characters]' ELSE x END), '') AS line
FROM (SELECT doc_id, 'key sk_' || replace(md5(doc_id::VARCHAR), '0', '_') || ' sk_short ' || text AS line FROM documents)""")
def text_redact(spark, sf_dir):
    line = F.concat(F.lit("key sk_"), F.replace(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("0"), F.lit("_")), F.lit(" sk_short "), F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", text.redact(line).alias("line"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY list_transform(regexp_extract_all(n, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN x[1] BETWEEN '0' AND '9' THEN '0' || lpad(x, 20, '0') ELSE '1' || lower(x) END), p_partkey) AS place FROM (SELECT p_partkey, p_name || ' ' || (p_partkey % 113)::VARCHAR || ' side ' || (p_size * 7)::VARCHAR AS n FROM part)""")
def natural_order(spark, sf_dir):
    """Place of each part's made-up file name in natural order: a range sort, then counts of the ranges before."""
    part = _read(spark, sf_dir, "part").select("p_partkey", text.natural_key(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 113).cast("string"), F.lit(" side "), (F.col("p_size") * 7).cast("string"))).alias("k"))
    return _numbered(part, ["k", "p_partkey"], "place").select("p_partkey", "place")


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 in an order, without one task that sees them all.

    The ranges are a table in the shared folder, so that both who counts them and who numbers in them see the same.
    """
    from pyspark.sql import Window

    where = shared_folder(df.sparkSession)
    df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).write.parquet(where)
    ranged = df.sparkSession.read.parquet(where)
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    within = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return within.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + F.col("__k")).drop("__p", "__before", "__k")


# --- numbers as they are said ---------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s // 60 = 0 THEN sec WHEN s % 60 = 0 THEN min ELSE min || ' ' || sec END AS said FROM (SELECT *, CASE s % 60 WHEN 1 THEN '1 second' ELSE (s % 60) || ' seconds' END AS sec, CASE s // 60 WHEN 1 THEN '1 minute' ELSE (s // 60) || ' minutes' END AS min FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 100)::BIGINT AS s FROM lineitem))""")
def spoken_time(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", spoken.spoken_time(F.col("l_extendedprice") / 100).alias("said"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN b >= 1073741824 THEN printf('%.1f', b / 1073741824.0) || ' gigabytes' WHEN b >= 1048576 THEN printf('%.1f', b / 1048576.0) || ' megabytes' WHEN b >= 1024 THEN printf('%.0f', b / 1024.0) || ' kilobytes' WHEN b = 0 THEN 'no bytes' WHEN b = 1 THEN '1 byte' ELSE b || ' bytes' END AS said FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_orderkey % 1024 WHEN 1 THEN l_orderkey * 512 WHEN 2 THEN l_orderkey * 65536 ELSE l_orderkey * 16777216 END AS b FROM lineitem)""")
def spoken_bytes(spark, sf_dir):
    k = F.col("l_orderkey")
    b = F.when(F.col("l_linenumber") % 4 == 0, k % 1024).when(F.col("l_linenumber") % 4 == 1, k * 512).when(F.col("l_linenumber") % 4 == 2, k * 65536).otherwise(k * 16777216)
    return _read(spark, sf_dir, "lineitem").withColumn("b", b).select("l_orderkey", "l_linenumber", spoken.spoken_bytes("b").alias("said"))


@query("SELECT p_partkey, greatest(-10, least(10, round(ln(greatest(50.0, least(500.0, 40 + p_size * 12.0)) / 175.0) / ln(1.15))))::INTEGER AS rate FROM part")
def sapi_rate(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", spoken.sapi_rate(40 + F.col("p_size") * 12.0).alias("rate"))


@query("SELECT p_partkey, CASE WHEN greatest(w, h) > 2048 THEN greatest(round(w * (2048.0 / greatest(w, h)))::INTEGER, 1) ELSE w::INTEGER END AS width, CASE WHEN greatest(w, h) > 2048 THEN greatest(round(h * (2048.0 / greatest(w, h)))::INTEGER, 1) ELSE h::INTEGER END AS height FROM (SELECT p_partkey, p_size * 131 AS w, (p_partkey % 4000)::INTEGER + 1 AS h FROM part)")
def image_fit(spark, sf_dir):
    size = spoken.fit_within(F.col("p_size") * 131, (F.col("p_partkey") % 4000).cast("int") + 1)
    return _read(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


# --- sequences ------------------------------------------------------------------------------------------------------

_PAGES = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, value > 40 AS bad FROM events"


def _pages(spark, sf_dir):
    from pyspark.sql import Window

    return _read(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("page"), (F.col("value") > 40).alias("bad"))


@query(f"SELECT user_id, min(page) AS first, max(page) AS last FROM (SELECT user_id, page, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS i FROM ({_PAGES}) WHERE bad) GROUP BY user_id, i")
def page_runs(spark, sf_dir):
    return sequences.runs(_pages(spark, sf_dir), "bad", "user_id", "page")


@query(f"SELECT user_id, CASE sum(n) WHEN 1 THEN 'page ' ELSE 'pages ' END || string_agg(CASE WHEN a = b THEN a::VARCHAR WHEN b = a + 1 THEN a || ' and ' || b ELSE a || '–' || b END, ', ' ORDER BY a) AS said FROM (SELECT user_id, min(page) AS a, max(page) AS b, count(*) AS n FROM (SELECT user_id, page, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS i FROM ({_PAGES}) WHERE bad) GROUP BY user_id, i) GROUP BY user_id")
def page_ranges(spark, sf_dir):
    return sequences.ranges(_pages(spark, sf_dir).filter("bad"), "user_id", "page")


@query("""WITH RECURSIVE f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), value) AS i, epoch_us(ts) / 1000000.0 AS t, value / 100 AS scene FROM events),
k AS (SELECT user_id, i, t, t AS last, true AS kept, 1 AS n FROM f WHERE i = 1
 UNION ALL SELECT f.user_id, f.i, f.t, CASE WHEN k.n < 40 AND (f.scene >= 0.9 OR f.t - k.last >= 30000) THEN f.t ELSE k.last END, k.n < 40 AND (f.scene >= 0.9 OR f.t - k.last >= 30000), k.n + (k.n < 40 AND (f.scene >= 0.9 OR f.t - k.last >= 30000))::INTEGER FROM k JOIN f ON f.user_id = k.user_id AND f.i = k.i + 1)
SELECT user_id, t FROM k WHERE kept""")
def frame_sample(spark, sf_dir):
    """Frames kept of each video; a user's events are one."""
    t = F.expr("unix_micros(cast(ts as timestamp)) / 1000000D")
    frames = _read(spark, sf_dir, "events").select("user_id", t.alias("t"), (F.col("value") / 100).alias("scene"))
    return frame_chain.sample_frames(frames, "user_id", written, scene=0.9, floor=30000.0)


#: Number, name and parts of each colour (fixed values, in full).
_COLOURS = """(0, 'black', 0, 0, 0), (1, 'white', 255, 255, 255), (2, 'grey', 128, 128, 128), (3, 'red', 255, 0, 0), (4, 'dark red', 139, 0, 0), (5, 'orange', 255, 165, 0), (6, 'yellow', 255, 255, 0), (7, 'green', 0, 128, 0), (8, 'light green', 144, 238, 144), (9, 'blue', 0, 0, 255), (10, 'dark blue', 0, 0, 139), (11, 'light blue', 173, 216, 230), (12, 'purple', 128, 0, 128), (13, 'pink', 255, 192, 203), (14, 'brown', 165, 42, 42), (15, 'teal', 0, 128, 128)"""


@query(f"WITH c(i, name, r, g, b) AS (VALUES {_COLOURS}), p AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part) SELECT p_partkey, nullif(arg_min(name, [(((v >> 16) - r) * ((v >> 16) - r) + (((v >> 8) & 255) - g) * (((v >> 8) & 255) - g) + ((v & 255) - b) * ((v & 255) - b))::BIGINT, i]), 'black') AS colour FROM p, c GROUP BY p_partkey")
def nearest_colour(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", sequences.nearest_colour((F.col("p_partkey") * 7919 % 16777216).cast("int")).alias("colour"))


# --- captures from bytes to report ----------------------------------------------------------------------------------


@query(f"SELECT * EXCLUDE (bytes) FROM (SELECT {_KEYS}, packets, bytes, first_ns, last_ns, opens, resets, finishes, accepted FROM ({_CONV}))")
def pcap_roundtrip(spark, sf_dir):
    """Frames built, written in the capture format, read, decoded and rolled up: the same conversations."""
    from ..sources import capture, packet
    from .formats import capture_files, classic

    read = packet.decoded(capture.read_content(capture_files(spark, sf_dir, classic))).withColumn("file", F.lit("events"))
    return flows.conversations(read).select(*_wide(), "packets", "first_ns", "last_ns", "opens", "resets", "finishes", "accepted")


# --- messages, tables, archives, office files -----------------------------------------------------------------------

_CATEGORY = "CASE r WHEN 'french' THEN CASE WHEN n <= 1 THEN 'one' ELSE 'other' END WHEN 'polish' THEN CASE WHEN n = 1 THEN 'one' WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END WHEN 'russian' THEN CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 'one' WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END ELSE CASE WHEN n = 1 THEN 'one' ELSE 'other' END END"
_RULE_OF = "CASE o_orderkey % 4 WHEN 0 THEN 'one_other' WHEN 1 THEN 'french' WHEN 2 THEN 'polish' ELSE 'russian' END"


@query(f"SELECT o_orderkey, {_CATEGORY} AS category FROM (SELECT o_orderkey, {_RULE_OF} AS r, o_custkey % 130 AS n FROM orders)")
def plural_forms(spark, sf_dir):
    from ..functions import messages

    return _read(spark, sf_dir, "orders").select("o_orderkey", messages.category(F.expr(_RULE_OF), F.col("o_custkey") % 130).alias("category"))


@query("SELECT o_orderkey, v || ' has {left} of ' || o_custkey || ', } {other}' || CASE WHEN o_orderkey % 2 = 0 THEN v ELSE '{n' || chr(10) END AS said FROM (SELECT *, CASE o_custkey % 4 WHEN 0 THEN '{n} {{x' WHEN 1 THEN '}} {what}' ELSE o_orderpriority END AS v FROM orders)")
def template_fill(spark, sf_dir):
    """Values that hold slots and braces of their own, and a name that the template's end leaves open."""
    from ..functions import messages

    what = F.expr("CASE o_custkey % 4 WHEN 0 THEN '{n} {{x' WHEN 1 THEN '}} {what}' ELSE o_orderpriority END")
    values = F.create_map(F.lit("what"), what, F.lit("n"), F.col("o_custkey").cast("string"))
    template = F.concat(F.lit("{what} has {{left}} of {n}, }} {other}"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("{what")).otherwise(F.lit("{n\n")))
    return _read(spark, sf_dir, "orders").select("o_orderkey", messages.filled(template, values).alias("said"))


@query("SELECT c_custkey, CASE WHEN l IN ('de', 'fr') THEN l WHEN l = 'fr-ca' THEN 'fr' WHEN l = 'de_at' THEN 'de' ELSE 'en' END AS lang FROM (SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'de' WHEN 1 THEN 'fr-ca' WHEN 2 THEN 'de_at' WHEN 3 THEN 'fr' ELSE 'ja' END AS l FROM customer)")
def language_match(spark, sf_dir):
    from ..functions import messages

    wanted = F.expr("CASE c_nationkey % 5 WHEN 0 THEN 'DE' WHEN 1 THEN 'fr-CA' WHEN 2 THEN 'de_AT' WHEN 3 THEN 'fr' ELSE 'ja' END")
    return _read(spark, sf_dir, "customer").select("c_custkey", messages.matched_language(wanted, ["en", "de", "fr"]).alias("lang"))


@query("SELECT 'nation.csv' AS path, 'Table with 25 rows and 3 columns.' || chr(10) || chr(10) || string_agg('Row ' || i || '. n nationkey: ' || n_nationkey || '. n name: ' || n_name || ', \"the\" one. Column 3: ' || CASE WHEN n_regionkey = 0 THEN 'empty.' ELSE n_regionkey || '.' END, chr(10) ORDER BY i) AS text FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation)")
def table_spoken(spark, sf_dir):
    """nation written as delimited text, with quotes and an empty heading, read by the exact parser and narrated."""
    from ..sources import files

    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit(', ""the"" one",'), F.when(F.col("n_regionkey") == 0, F.lit(" ")).otherwise(F.col("n_regionkey").cast("string"))).alias("line"))
    text = rows.agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "line"))).alias("all")).select(F.concat(F.lit("n_nationkey,n_name,\r\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\r\n")).alias("text"))
    return files.speak_tables(files.read_tables(text.select(F.lit("nation.csv").alias("path"), F.col("text").cast("binary").alias("content"))))


def _playlist(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    brand = F.col("p_brand")
    have = part.select(brand.alias("archive"), F.col("p_partkey").cast("int").alias("entry_index"), F.concat(F.lit("Disc/"), F.lower("p_name"), F.lit(" "), (F.col("p_partkey") % 9).cast("string"), F.lit(".mp3")).alias("path"))
    listed = part.filter("p_partkey % 3 < 2").select(brand.alias("archive"), F.col("p_partkey").cast("int").alias("line"), F.concat(F.when(F.col("p_partkey") % 11 == 0, F.lit("lost ")).otherwise(F.lit("")), F.upper("p_name"), F.lit(" "), (F.col("p_partkey") % 9).cast("string"), F.lit(".MP3")).alias("name"), F.lit("speech").alias("kind"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_size").cast("long")).alias("pos"))
    return have, listed


_LISTED = """w AS (SELECT *, row_number() OVER (PARTITION BY archive, key ORDER BY pos2) AS k FROM (SELECT p_brand AS archive, p_partkey AS line, name, lower(name) AS key, row_number() OVER (PARTITION BY p_brand ORDER BY pos NULLS LAST, p_partkey) AS pos2 FROM (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'lost ' ELSE '' END || upper(p_name) || ' ' || (p_partkey % 9) || '.MP3' AS name, CASE WHEN p_partkey % 5 > 0 THEN p_size END AS pos FROM part WHERE p_partkey % 3 < 2)) WHERE pos2 <= 500),
h AS (SELECT *, row_number() OVER (PARTITION BY archive, key ORDER BY nat, entry_index) AS k FROM (SELECT p_brand AS archive, p_partkey::INTEGER AS entry_index, 'Disc/' || n AS path, n AS key, list_transform(regexp_extract_all('Disc/' || n, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN x[1] BETWEEN '0' AND '9' THEN '0' || lpad(x, 20, '0') ELSE '1' || lower(x) END) AS nat FROM (SELECT *, lower(p_name) || ' ' || (p_partkey % 9) || '.mp3' AS n FROM part)))"""


@query(f"WITH {_LISTED}, t AS (SELECT h.archive, h.path, 'speech' AS kind, h.entry_index, 0 AS part, w.pos2, NULL AS nat FROM w JOIN h ON w.archive = h.archive AND w.key = h.key AND w.k = h.k UNION ALL SELECT h.archive, h.path, 'unlisted', h.entry_index, 1, 0, h.nat FROM h WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.archive = h.archive AND w.key = h.key AND w.k = h.k)) SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY part, pos2, nat, entry_index) AS track_no, path, kind, entry_index::BIGINT AS entry_index FROM t QUALIFY track_no <= 500")
def playlist_arrange(spark, sf_dir):
    tracks = sequences.arrange(*_playlist(spark, sf_dir))[0]
    return tracks.select("archive", F.col("track_no").cast("long").alias("track_no"), "path", "kind", F.col("entry_index").cast("long").alias("entry_index"))


@query(f"WITH {_LISTED} SELECT archive, line::BIGINT AS line, name FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE w.archive = h.archive AND w.key = h.key AND w.k = h.k)")
def playlist_missing(spark, sf_dir):
    missing = sequences.arrange(*_playlist(spark, sf_dir))[1]
    return missing.select("archive", F.col("line").cast("long").alias("line"), "name")


_TIDIED = SQL["text_tidy"]


@query(f"SELECT concat('doc-', doc_id::VARCHAR) AS path, tidied AS text FROM ({_TIDIED})")
def docx_roundtrip(spark, sf_dir):
    """Documents written as Word files, one paragraph a line, and read back."""
    return _office(spark, sf_dir, "word")


@query(f"SELECT concat('doc-', doc_id::VARCHAR) AS path, tidied AS text FROM ({_TIDIED})")
def text_decode_roundtrip(spark, sf_dir):
    """Documents as bytes in UTF-8, UTF-16 of both orders (marked) and read back."""
    from ..sources import files

    docs = _read(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 4
    content = (
        F.when(kind == 0, F.col("text").cast("binary")).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
    )
    return files.read_text(docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), content.alias("content"))).select("path", "text")


def _office(spark, sf_dir, kind):
    from ..sources import office
    from .fixtures import word_file

    def made(batches):
        import pyarrow as pa

        for b in (x.slice(i, 64) for x in batches for i in range(0, x.num_rows, 64)):
            texts = [word_file(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], ["path", "content"])

    docs = _read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), "text")
    return office.read_word(spread(docs, "path").mapInArrow(made, "path string, content binary")).select("path", "text")


@query("SELECT concat('deck-', conv_id::VARCHAR) AS path, 'Presentation with ' || CASE count(*) WHEN 1 THEN '1 slide' ELSE count(*) || ' slides' END || '.' || string_agg(chr(10) || chr(10) || 'Slide ' || i || ' of ' || n || '. ' || role || '.' || chr(10) || 'turn ' || turn || '.' || CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '[.!?:;,]$') THEN chr(10) || t ELSE chr(10) || t || '.' END, '' ORDER BY i) AS text FROM (SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '^" + _WS + "+', ''), '" + _WS + "+$', '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE turn <> 3) GROUP BY conv_id")
def pptx_roundtrip(spark, sf_dir):
    """Conversations as decks, a slide a turn, the fourth hidden, read back and narrated."""
    import pyarrow as pa

    from ..sources import office
    from .fixtures import slide_file

    def decks(key, table):
        rows = table.sort_by("turn").to_pylist()
        return pa.table({"path": [f"deck-{key[0].as_py()}"], "content": pa.array([slide_file([(r["role"], [f"turn {r['turn']}", r["text"] or ""], r["turn"] == 3) for r in rows])], pa.binary())})

    made = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInArrow(decks, "path string, content binary")
    return office.speak_slides(office.read_slides(made)).filter("error is null").select("path", "text")


@query("SELECT concat('pdf-', doc_id::VARCHAR) AS path, array_to_string(list_transform(range(0, len(w), 12), lambda i: array_to_string(w[i + 1:i + 12], ' ')), chr(10)) AS text FROM (SELECT doc_id, regexp_extract_all(text, '[!-~¡-¬®-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]+') AS w FROM documents)")
def pdf_roundtrip(spark, sf_dir):
    """Each document's words drawn as a PDF page, twelve a line, and read back."""
    import pyarrow as pa

    from ..sources import pdf
    from .fixtures import pdf_file

    def made(batches):
        for b in (x.slice(i, 64) for x in batches for i in range(0, x.num_rows, 64)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pdf_file([t or ""], i % 2 == 0) for i, t in enumerate(b.column(1).to_pylist())], pa.binary())], ["path", "content"])

    # the words are a column of their own: within the lambda they would be looked for once a line
    words = spread(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.concat(F.lit("pdf-"), F.col("doc_id").cast("string")).alias("path"), F.regexp_extract_all("text", F.lit("[!-~¡-¬®-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]+"), F.lit(0)).alias("words"))
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 12).cast("int")), lambda i: F.array_join(F.slice("words", i * 12 + 1, 12), " "))
    docs = words.select("path", F.when(F.size("words") > 0, F.array_join(lines, "\n")).otherwise("").alias("text"))
    return pdf.read_pages(docs.mapInArrow(made, "path string, content binary")).select("path", "text")


@query("SELECT 'v' || user_id AS path, string_agg(CASE WHEN t < 1 THEN 'At the start' ELSE (CASE WHEN t // 60 = 0 THEN s WHEN t % 60 = 0 THEN m ELSE m || ' ' || s END) || ' in' END || ': saw ' || event_type, chr(10) || chr(10) ORDER BY t, event_type) AS text FROM (SELECT *, CASE t % 60 WHEN 1 THEN '1 second' ELSE (t % 60) || ' seconds' END AS s, CASE t // 60 WHEN 1 THEN '1 minute' ELSE (t // 60) || ' minutes' END AS m FROM (SELECT event_type, user_id, event_id // 7 AS t FROM events WHERE user_id % 5 > 0)) GROUP BY user_id")
def video_transcript(spark, sf_dir):
    from ..sources import media

    text_ = F.when(F.col("user_id") % 5 > 0, F.concat(F.lit(" saw "), F.col("event_type"))).otherwise(F.lit(" \n"))
    frames = _read(spark, sf_dir, "events").select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("path"), F.floor(F.col("event_id") / 7).alias("t"), text_.alias("text"))
    return media.video_transcript(frames.withColumn("t", F.col("t").cast("double")))


@query("SELECT path, kind, pos::BIGINT AS pos, ms, (sum(ms) OVER (PARTITION BY path ORDER BY pos) - ms - sum(early) OVER (PARTITION BY path ORDER BY pos))::BIGINT AS start_ms FROM (SELECT *, CASE WHEN kind = 'music' AND lag(kind) OVER w = 'speech' THEN least(1250, lag(ms) OVER w) ELSE 0 END AS early FROM (SELECT o_custkey::VARCHAR AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'speech' ELSE 'music' END AS kind, (o_orderkey * 37) % 4000 AS ms FROM orders) WINDOW w AS (PARTITION BY path ORDER BY pos))")
def track_schedule(spark, sf_dir):
    from pyspark.sql import Window

    o = _read(spark, sf_dir, "orders")
    tracks = o.select(F.col("o_custkey").cast("string").alias("archive"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("track_no"), F.when(F.col("o_orderkey") % 2 == 0, "speech").otherwise("music").alias("kind"), (F.col("o_orderkey") * 37 % 4000).alias("ms"))
    return sequences.overlap_schedule(tracks).select(F.col("archive").alias("path"), "kind", F.col("track_no").alias("pos"), "ms", "start_ms")


@query("SELECT 'ip' AS x, proto_num::BIGINT AS proto_num, low_addr, high_addr, packets, bytes FROM (SELECT proto_num, %s AS low_addr, %s AS high_addr, count(*) AS packets, sum(bytes)::BIGINT AS bytes FROM (%s) AS p WHERE kind = 'ip' GROUP BY ALL)" % (duck_address("least(src_num, dst_num)"), duck_address("greatest(src_num, dst_num)"), PACKETS))
def stream_conversations(spark, sf_dir):
    """The windowed rollup as a stream over the packets as files, its windows summed: a check of the streaming form."""
    from ..streaming.flows import windowed_conversations

    rows = packets(spark, sf_dir).select("kind", "at_ns", "src", "dst", "src_key", "dst_key", "proto_num", "bytes")
    where = shared_folder(spark)
    rows.write.parquet(f"{where}/in")
    made = windowed_conversations(spark.readStream.schema(rows.schema).parquet(f"{where}/in"), "1 day", "40 days")

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{where}/out-{epoch}")

    q = made.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(int(p["batchId"]) for p in q.recentProgress)
    out = spark.read.parquet(f"{where}/out-{last}")
    return out.groupBy(F.col("proto_num").cast("long").alias("proto_num"), "low_addr", "high_addr").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")).withColumn("x", F.lit("ip"))


from . import decisions, formats  # noqa: E402, F401 - they register their queries
