"""Queries of the decisions, spoken forms and messages, over the driver's tables; expected values stand in the SQL."""

from __future__ import annotations

import functools

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import jobs, messages, spoken, text
from ..operators import replacements, reuse, sequences
from ..sources import files, media, replies
from . import capture_report
from .registry import query, read, shared_folder, written


def _pick(n: str, values: list) -> Column:
    """The value at n, which counts from 0 over and over."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({n} % {len(values)} as int)"))


def _sql(n: str, values: list) -> str:
    quoted = ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"list_value({quoted})[({n} % {len(values)})::INTEGER + 1]"


_EXTENSIONS = [".txt", ".MD", ".docx", ".PDF", ".tsv", ".pptx", ".pcapng", ".HEIC", ".jpg", ".webm", ".ppt", ".exe", ""]
_KINDS = ["text", "text", "docx", "pdf", "csv", "pptx", "pcap", "image", "image", "video", None, None, None]


@query(f"""SELECT p_partkey, {_sql('p_partkey', _KINDS)} AS kind, p_partkey % 13 IN (7, 8) AS photo, p_partkey % 13 <= 5 AS headless,
 CASE p_partkey % 13 WHEN 10 THEN 'this is the old PowerPoint format: save it again as .pptx' WHEN 11 THEN replace(p_name, ' ', '_') || '.exe is not a file type this app can read' WHEN 12 THEN replace(p_name, ' ', '_') || ' is not a file type this app can read' END AS refused FROM part""")
def file_kinds(spark, sf_dir):
    path = F.concat(F.lit("/in/a.b/"), F.replace("p_name", F.lit(" "), F.lit("_")), _pick("p_partkey", _EXTENSIONS))
    made = read(spark, sf_dir, "part").select("p_partkey", path.alias("path")).withColumn("kind", files.kind_of(F.col("path")))
    return made.select("p_partkey", "kind", media.is_photo(F.col("path")).alias("photo"), F.coalesce(F.col("kind").isin(*jobs.HEADLESS), F.lit(False)).alias("headless"), files.refusal(F.col("path")).alias("refused"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'dark' ELSE 'light' END AS theme, CASE WHEN c_custkey % 4 = 0 THEN c_custkey::VARCHAR ELSE '150' END AS speed,
 CASE WHEN c_custkey % 3 = 0 THEN 'k' || c_custkey WHEN c_custkey % 3 = 1 THEN 'stored' END AS key, CASE c_custkey % 3 WHEN 0 THEN 'b' ELSE CASE c_custkey % 5 WHEN 0 THEN 'v' ELSE 'a' END END AS voice FROM customer""")
def saved_settings(spark, sf_dir):
    """Settings over defaults (also from what isn't JSON), the key's precedence, and a saved voice that is or isn't there."""
    k = F.col("c_custkey")
    id_ = k.cast("string")
    saved = F.when(k % 4 == 0, F.concat(F.lit('{"theme": "dark", "speed": '), id_, F.lit(', "unknown": [1]}'))).when(k % 4 == 1, F.lit("[1]")).when(k % 4 == 2, F.lit("{broken"))
    got = jobs.settings(saved, {"theme": "light", "speed": "150"})
    key = jobs.api_key(F.when(k % 3 == 0, F.concat(F.lit(" k"), id_, F.lit("\n"))).otherwise(F.lit("  ")), F.when(k % 3 == 1, F.lit("stored")))
    voices = F.when(k % 5 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("a"), F.lit("b")))
    voice = F.when(k % 3 == 0, F.lit("b")).otherwise(jobs.kept_voice(F.lit("v"), voices))
    return read(spark, sf_dir, "customer").select("c_custkey", got["theme"].alias("theme"), got["speed"].alias("speed"), key.alias("key"), voice.alias("voice"))


_MODELS = ["Llama3.2-Vision:11b", "", None, "llama3.2-vision", "gemma3:4b", "  ", "qwen2.5vl:3b"]
_NOW = ["qwen2.5vl:3b", "qwen2.5vl:3b", "qwen2.5vl:3b", "qwen2.5vl:3b", "gemma3:4b", "qwen2.5vl:3b", "qwen2.5vl:3b"]
_ERRORS = ["model requires more system memory (9 GiB)", "unknown model architecture: 'mllama'", "EOF", "available memory is too low"]
_CLASSES = ["memory", "model too old", "other", "memory"]
_LOCALES = ["C.UTF-8", "fr_FR.UTF-8", "POSIX", "", "de", "C"]
_NAMED = [None, "fr-FR", None, None, "de", None]


@query(f"""SELECT o_orderkey, {_sql('o_orderkey', _NOW)} AS model, {_sql('o_orderkey', _CLASSES)} AS failure,
 coalesce({_sql('o_orderkey', _NAMED)}, {_sql('o_custkey', _NAMED)}) AS language,
 CASE o_orderkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'new' WHEN 2 THEN ' mine ' ELSE 'new' END AS prompt, CASE WHEN o_orderkey % 3 < 2 THEN 'eleven_labs' ELSE 'system' END AS saved_engine,
 CASE WHEN o_orderkey % 4 = 3 AND o_custkey % 2 = 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'unsupported' ELSE 'system' END WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 5 = 0 THEN 'missing key' ELSE 'cloud' END ELSE CASE WHEN o_custkey % 3 = 0 THEN 'unsupported' ELSE 'system' END END AS engine,
 o_orderkey % 3 <> 1 AS voice_ok, CASE WHEN o_orderkey % 2 = 0 THEN 'https://x/' || o_orderkey ELSE 'page' END AS url, o_orderkey % 50 < 40 AS fragment,
 CASE o_orderkey % 4 WHEN 0 THEN 'british, well spoken' WHEN 1 THEN 'british' WHEN 2 THEN 'well spoken' ELSE 'premade' END AS detail,
 (o_custkey % 4 + least(1.0, greatest(0.0, (o_orderkey % 7 - 1) / 4.0))) / 4 AS progress, greatest(0.0, o_orderkey % 30 - 10.0)::DOUBLE AS rewound
 FROM orders""")
def job_decisions(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", jobs.current_model(_pick("o_orderkey", _MODELS)).alias("model"), files.failure(_pick("o_orderkey", _ERRORS)).alias("failure"),
        jobs.system_language(_pick("o_orderkey", _LOCALES), _pick("o_custkey", _LOCALES)).alias("language"),
        jobs.current_prompt(_pick("o_orderkey", [" old\n", "", " mine ", None]), "old", "new").alias("prompt"), jobs.current_engine(_pick("o_orderkey", ["eleven_labs", "elevenlabs", "auto"])).alias("saved_engine"),
        jobs.engine(F.when(o % 3 == 0, F.lit("eleven_labs")).otherwise(F.lit("system")), c % 5 > 0, F.when(o % 4 == 3, F.lit("pcap")).otherwise(F.lit("text")), c % 2 == 1, c % 3 > 0).alias("engine"),
        jobs.is_voice_id(F.concat(F.lit("Ab-1_"), F.when(o % 3 == 1, F.lit("/")).otherwise(F.lit("")), o.cast("string"))).alias("voice_ok"),
        jobs.download_url(F.array(F.lit("http://y"), F.when(o % 2 == 0, F.concat(F.lit("https://x/"), o.cast("string"))).otherwise(F.lit("ftp://z"))), "page").alias("url"),
        jobs.is_fragment(F.concat(F.lit(" \n"), F.repeat(F.lit("x"), (o % 50).cast("int")), F.lit(" "))).alias("fragment"),
        jobs.voice_detail(F.when(o % 4 < 2, F.lit("british")), F.when(o % 2 == 0, F.lit("well_spoken")).otherwise(F.lit("")), F.lit("premade")).alias("detail"),
        jobs.progress(c % 4, F.lit(4), (o % 7 - 1) / 4).alias("progress"), jobs.rewind((o % 30).cast("double")).alias("rewound"),
    )


_NAMED = "CASE p_partkey % 5 WHEN 0 THEN replace(p_brand, '#', '') WHEN 1 THEN concat(p_brand, ' (', CAST(p_size AS {text}), ').x.mp3') WHEN 2 THEN concat(p_brand, '.x (', CAST(2 + p_size % 9 AS {text}), ').mp3') ELSE concat(p_brand, '.x.mp3') END"


@query(f"""WITH p AS (SELECT p_partkey, {_NAMED.format(text="VARCHAR")} AS name FROM part), u AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) - 1 AS k FROM p),
x AS (SELECT name, count(*) AS n, CASE WHEN name LIKE '%.mp3' THEN name[:-5] ELSE name END AS stem, CASE WHEN name LIKE '%.mp3' THEN '.mp3' ELSE '' END AS ext FROM p GROUP BY name),
f AS (SELECT name, made, row_number() OVER (PARTITION BY name ORDER BY i) AS k FROM (SELECT name, i, stem || ' (' || i || ')' || ext AS made FROM (SELECT *, unnest(range(2, n + 60)) AS i FROM x)) AS c WHERE made NOT IN (SELECT name FROM p))
SELECT p_partkey, coalesce(f.made, u.name) AS name FROM u LEFT JOIN f ON f.name = u.name AND f.k = u.k""")
def file_names(spark, sf_dir):
    """Names made unique, with an extension (the last dot's) and without, where some have the names that others would be given."""
    return jobs.unique_names(read(spark, sf_dir, "part").select("p_partkey", F.expr(_NAMED.format(text="STRING")).alias("name")), "name", "p_partkey").select("p_partkey", F.col("unique").alias("name"))


_PROMPTS = ["Describe it.", "  Describe it.\n", "Beschreibe es.", "My own prompt", "", "   ", "Describe it"]


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {_sql('o_orderkey', [1, 1, 1, 0, 1, 1, 0])} AS hit FROM orders) WHERE hit = 1")
def untouched_prompts(spark, sf_dir):
    defaults = spark.createDataFrame([("Describe it.",), ("Beschreibe es.",)], "prompt string")
    return jobs.is_untouched(read(spark, sf_dir, "orders").select("o_orderkey", _pick("o_orderkey", _PROMPTS).alias("prompt")), defaults).select("o_orderkey")


@query("""SELECT doc_id, sha256('{"f0":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"' || doc_id || '"' END || ',"f1":' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || '}') AS print,
 CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id || ' text.' || chr(10) || chr(10) || 'Read by Eleven Labs.' ELSE 'Doc ' || doc_id || ' text.' END AS said, (doc_id + 1) % 2 AS made,
 'doc-' || doc_id || ': ' || coalesce(length(text), 0) || ' characters' || CASE WHEN doc_id % 5 = 0 THEN ' · 2 pages could not be read' ELSE '' END AS note FROM documents""")
def spoken_results(spark, sf_dir):
    """The fingerprint of a result, what is spoken of it (text, the engine's note, then the rules), and a reader's note."""
    d = F.col("doc_id")
    id_ = d.cast("string")
    said, made = jobs.speech(F.concat(F.lit("Doc "), id_, F.lit(" text.")), F.when(d % 2 == 0, F.lit("Read by ElevenLabs.")), [text.Rule(" ", "x"), text.Rule("ElevenLabs", "Eleven Labs")])
    note = jobs.extracted(F.concat(F.lit("doc-"), id_), F.coalesce("text", F.lit("")), F.when(d % 5 == 0, F.lit("2 pages could not be read")))["note"]
    return read(spark, sf_dir, "documents").select("doc_id", jobs.fingerprint(F.when(d % 3 > 0, d), F.col("lang")).alias("print"), said.alias("said"), made.alias("made"), note.alias("note"))


@query("""SELECT l_orderkey, l_linenumber, list_transform([l_discount * 30 - 1, -l_tax, 2.0], lambda x: trunc(greatest(-1.0, least(1.0, x)) * 32767)::SMALLINT)::VARCHAR AS samples FROM lineitem""")
def audio_samples(spark, sf_dir):
    made = jobs.samples(F.array(F.col("l_discount") * 30 - 1, -F.col("l_tax"), F.lit(2.0)))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("["), F.array_join(made.cast("array<string>"), ", "), F.lit("]")).alias("samples"))


@query("""SELECT c_custkey, trim(c_name) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'en_GB' ELSE 'pt-BR' END AS locale, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Hello, I am ' || c_custkey END AS sample FROM customer WHERE c_custkey % 7 > 0""")
def voice_list(spark, sf_dir):
    """The lines of a voice list; those of another shape are left out."""
    k = F.col("c_custkey")
    line = F.when(k % 7 == 0, F.concat("c_name", F.lit(" en_GB"))).otherwise(F.concat("c_name", F.lit("   "), F.when(k % 2 == 0, F.lit("en_GB")).otherwise(F.lit("pt-BR")), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("    # Hello, I am "), k.cast("string")))))
    return files.voice_lines(read(spark, sf_dir, "customer").select(line.alias("value"))).select(F.regexp_extract("id", r"0*(\d+)$", 1).cast("long").alias("c_custkey"), "id", "locale", "sample")


@query("SELECT c_name AS id, CASE WHEN c_custkey % 2 = 0 THEN 'de-AT' ELSE '' END AS culture FROM customer WHERE c_custkey % 5 > 0")
def voice_table(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.concat(F.when(k % 5 > 0, F.concat(F.lit(" "), F.col("c_name"))).otherwise(F.lit(" ")), F.when(k % 2 == 0, F.lit("\tde-AT ")).otherwise(F.lit("")))
    return files.voice_pairs(read(spark, sf_dir, "customer").select(line.alias("value")))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Ulm, BW, Germany' WHEN 1 THEN 'Hay, Powys' WHEN 2 THEN 'Place ' || c_custkey WHEN 3 THEN 'Oia, Greece' ELSE 'M' || c_custkey END AS place,
 c_custkey % 3 <> 1 AS has_model, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 3 THEN NULL ELSE c_custkey / 4.0 END AS seconds FROM customer""")
def json_answers(spark, sf_dir):
    """Place names and models out of JSON answers, and times out of a decoder's lines."""
    k = F.col("c_custkey")
    id_ = k.cast("string")
    parts = ['{"city": "Ulm", "state": "BW", "country": "Germany"}', '{"town": "Hay", "state": "Powys"}', "{}", '{"village": "Oia", "country": "Greece"}']
    address = F.when(k % 5 == 4, F.concat(F.lit('{"municipality": "M'), id_, F.lit('"}'))).otherwise(_pick("c_custkey % 5", parts))
    answer = F.from_json(F.concat(F.lit('{"display_name": "Place '), id_, F.lit('", "address": '), address, F.lit("}")), "display_name string, address struct<city:string,town:string,village:string,municipality:string,state:string,country:string>")
    names = files.model_names(F.lit('{"models": [{"name": "a:1"}, {"name": "b:latest"}]}'))
    line = F.when(k % 4 == 0, F.lit("pts_time:-3")).when(k % 4 == 3, F.lit("frame 3")).otherwise(F.concat(F.lit("n: 1 pts_time: "), (k / 4).cast("string"), F.lit(" pos: 2")))
    return read(spark, sf_dir, "customer").select("c_custkey", files.place_name(answer).alias("place"), files.has_model(names, _pick("c_custkey", ["a:1", "a", "b"])).alias("has_model"), files.frame_time(line).alias("seconds"))


@query("""SELECT 'reply' AS kind, doc_id AS key, doc_id || ' ' || coalesce(text, '') || ' .' AS said FROM documents UNION ALL SELECT 'broken', doc_id, NULL FROM documents
UNION ALL SELECT 'progress', o_orderkey, 'pulling ' || o_orderkey || ' ' || o_orderkey % 1025 FROM orders UNION ALL SELECT 'error', o_orderkey, 'no ' || o_custkey FROM orders WHERE o_orderkey % 9 = 0
UNION ALL SELECT 'voices', p_partkey, '0 0 ' || p_type || '; ' || p_partkey || ' ' || p_name || ' ' || p_brand FROM part UNION ALL SELECT 'place', c_custkey, c_name || ', ' || c_nationkey FROM customer
UNION ALL SELECT 'models', s_suppkey, s_name || ' b:1' FROM supplier UNION ALL SELECT 'release', n_nationkey, n_nationkey || '.0 ' || n_name || ' https://x/' || n_name FROM nation""")
def replies_told(spark, sf_dir):
    """All shapes of replies as lines of one column, told apart; texts are whole, and so are the lines that end too early."""
    line = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    s, lit = lambda c: F.col(c).cast("string"), F.lit
    take = lambda table, key, made: read(spark, sf_dir, table).select(F.col(key).cast("long").alias("key"), made.alias("line"))
    answer = line(response=F.concat(lit("  "), s("doc_id"), lit(" "), F.coalesce("text", lit("")), lit(" .\n")), done=lit(True))
    voice = lambda id_, name, more: F.named_struct(lit("voice_id"), id_, lit("name"), name, lit("category"), more, lit("labels"), F.create_map(lit("accent"), F.when(name != "0", more)))
    lines = [
        take("documents", "doc_id", answer), take("documents", "doc_id", F.left(answer, F.length(answer) - 1)),
        take("orders", "o_orderkey", line(status=F.concat(lit("pulling "), s("o_orderkey")), total=lit(1024), completed=F.col("o_orderkey") % 1025)), take("orders", "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, line(error=F.concat(lit("no "), s("o_custkey"))))),
        take("part", "p_partkey", line(voices=F.array(voice(s("p_partkey"), F.col("p_name"), F.col("p_brand")), voice(lit("0"), lit("0"), F.col("p_type"))))), take("customer", "c_custkey", line(address=F.struct(F.col("c_name").alias("village"), s("c_nationkey").alias("country")))),
        take("supplier", "s_suppkey", line(models=F.array(F.struct(F.col("s_name").alias("name")), F.struct(lit("b:1").alias("name"))))), take("nation", "n_nationkey", line(tag_name=F.concat(lit("v"), s("n_nationkey"), lit(".0")), body=F.col("n_name"), html_url=F.concat(lit("https://x/"), F.col("n_name")), assets=F.array().cast("array<string>"))),
    ]
    told = replies.read_replies(functools.reduce(lambda a, b: a.union(b), lines))
    voices = F.array_join(F.transform("voices", lambda v: F.concat_ws(" ", v["id"], v["name"], v["detail"])), "; ")
    progress = F.concat_ws(" ", "progress.status", (F.col("progress.fraction") * 1024).cast("int").cast("string"))
    said = {"reply": F.col("reply.text"), "error": F.col("error"), "progress": progress, "voices": voices, "place": F.col("place"), "models": F.array_join("models", " "), "release": F.concat_ws(" ", "release.version", "release.notes", "release.url")}
    return told.select("kind", "key", F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in said.items()]).alias("said"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'fe80 double colon ' || s_suppkey WHEN s_suppkey % 3 = 1 THEN '10 dot 0 dot 0 dot ' || s_suppkey % 256 ELSE s_suppkey || ' colon a colon 0' END AS address,
 'www dot host' || s_suppkey || ' dot example' AS name, CASE s_suppkey % 3 WHEN 0 THEN 'no packets' WHEN 1 THEN '1 packet' ELSE '2 packets' END AS counted,
 CASE WHEN s_suppkey % 2 = 0 THEN '10 dot 0 dot 0 dot 1' ELSE '10 dot 0 dot 0 dot 1 port ' || s_suppkey END AS endpoint, round_even(s_suppkey % 9 / 8.0 * 100, 0)::BIGINT AS percent, greatest(0, 40 - s_suppkey % 60) AS left FROM supplier""")
def spoken_network(spark, sf_dir):
    k = F.col("s_suppkey")
    id_ = k.cast("string")
    address = F.when(k % 3 == 0, F.concat(F.lit("fe80::"), id_)).when(k % 3 == 1, F.concat(F.lit("10.0.0."), (k % 256).cast("string"))).otherwise(F.concat(id_, F.lit(":a:0")))
    made = read(spark, sf_dir, "supplier").withColumn("addr", F.lit("10.0.0.1")).withColumn("port", F.when(k % 2 == 0, 0).otherwise(k))
    return made.select(
        "s_suppkey", spoken.spoken_address(address).alias("address"), spoken.spoken_name(F.concat(F.lit("www.host"), id_, F.lit(".example"))).alias("name"), spoken.counted(k % 3, "packet", "packets").alias("counted"),
        capture_report._endpoint("addr", "port").alias("endpoint"), spoken.percent(k % 9, F.lit(8)).alias("percent"), spoken.time_left(k % 60, F.lit(40)).alias("left"),
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN -d ELSE d END AS degrees, abs(c_acctbal / 50) <= 90 AND abs(c_acctbal / 30) <= 180 AS on_earth, strftime(make_timestamp(c_custkey * 86399000000), '%Y-%m-%d %H:%M:%S') AS date,
 CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS newer
 FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN (c_custkey % 90)::DOUBLE WHEN 1 THEN c_custkey % 90 + 30 / 60.0 ELSE c_custkey % 90 + 30 / 60.0 + 36 / 3600.0 END AS d FROM customer)""")
def places_and_dates(spark, sf_dir):
    k = F.col("c_custkey")
    parts = F.slice(F.array((k % 90).cast("double"), F.lit(30.0), F.lit(36.0)), F.lit(1), (k % 3 + 1).cast("int"))
    newer = spoken.is_newer(_pick("c_custkey", ["1.10.0", "1.2.0", "v2.0.0", "2.0.0-rc.1", "junk", "1.0.1+x"]), _pick("c_custkey", ["1.9.9", "1.2.0", "2.0.0-rc.1", "2.0.0", "1.0.0", "1.0.0"]))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", spoken.degrees(parts, F.when(k % 2 == 0, F.lit("s")).otherwise(F.lit("N"))).alias("degrees"), spoken.on_earth(F.col("c_acctbal") / 50, F.col("c_acctbal") / 30).alias("on_earth"),
        spoken.civil_date(k * 86399).alias("date"), newer.alias("newer"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'eigen ' || p_partkey WHEN p_partkey % 3 = 0 THEN 'base ' || p_partkey ELSE 'k.' || p_partkey END AS said FROM part""")
def message_lookup(spark, sf_dir):
    """A folder's language over the built-in one of its code, then English, then the key."""
    part = read(spark, sf_dir, "part")
    key = F.concat(F.lit("k."), F.col("p_partkey").cast("string"))
    word = lambda w: F.concat(F.lit(w), F.col("p_partkey").cast("string"))
    built_in = part.filter("p_partkey % 3 = 0").select(F.lit("en").alias("lang"), key.alias("key"), word("base ").alias("value")).union(part.select(F.lit("de-AT"), key, word("replaced ")))
    folder = part.filter("p_partkey % 2 = 0").select(F.lit("DE_at").alias("lang"), key.alias("key"), word("eigen ").alias("value")).union(part.select(F.lit("en"), key, word("never ")))
    entries = messages.override(built_in, folder)
    return messages.looked_up(part.select("p_partkey", key.alias("key")), entries, "DE_at").select("p_partkey", F.col("text").alias("said"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'w' WHEN 1 THEN 'o' WHEN 2 THEN 'm' WHEN 3 THEN '1' END AS form FROM orders")
def plural_variants(spark, sf_dir):
    """The wanted form of a message, else other, many, one."""
    k = F.col("o_orderkey") % 5
    none = F.lit(None).cast("string")
    forms = F.map_filter(F.create_map(F.lit("few"), F.when(k == 0, "w").otherwise(none), F.lit("other"), F.when(k <= 1, "o").otherwise(none), F.lit("many"), F.when(k <= 2, "m").otherwise(none), F.lit("one"), F.when(k <= 3, "1").otherwise(none)), lambda _, v: v.isNotNull())
    return read(spark, sf_dir, "orders").select("o_orderkey", messages.plural_form(forms, F.lit("few")).alias("form"))


@query("""SELECT code AS lang, key, value, line::INTEGER AS line, problem FROM (
 SELECT 'l' || n_nationkey AS code, 'code' AS key, 'l' || n_nationkey AS value, 2 AS line, NULL AS problem FROM nation UNION ALL
 SELECT 'l' || n_nationkey, 'name.' || n_nationkey, n_name || ' "x" and on', 3, NULL FROM nation UNION ALL
 SELECT 'l' || n_nationkey, 'twice', 'second', 7, NULL FROM nation UNION ALL
 SELECT 'l' || n_nationkey, NULL, NULL, x.line, x.problem FROM nation, (VALUES (7, '`twice` was already given a value further up'), (8, 'no `=`, so this is neither a comment nor an entry'), (9, '`B` cannot appear in a key'), (10, 'a value has to be wrapped in double quotes'), (11, 'the closing quote is missing'), (12, '`\\q` is not an escape this format knows'), (13, '`rest` is left over after the closing quote'), (15, 'a continued line with no entry above it to continue')) AS x(line, problem))""".replace("\\\\q", "\\q"))
def language_files(spark, sf_dir):
    """Language files with continued lines, escapes, a key given twice and each kind of broken line."""
    n = F.col("n_nationkey").cast("string")
    lines = [F.lit("# head"), F.concat(F.lit('code = "l'), n, F.lit('"')), F.concat(F.lit("name."), n, F.lit(' = "'), F.col("n_name"), F.lit(' \\"x\\" "')), F.lit('   "and on" # more'), F.lit(""), F.lit('twice = "first"'), F.lit('twice = "second"')]
    lines += [F.lit(x) for x in ("nothing here", 'aB = "x"', "c = x", 'd = "x', 'e = "\\q"', 'f = "x" rest', "", '"lost"')]
    return messages.read_languages(read(spark, sf_dir, "nation").select(F.concat_ws("\n", *lines).alias("text")))


_SHOWN = [4381, 3661, 1225, 0, 0, 96]
_LOST = [3, 39, 518, 1593, 4, 32]


@query(f"""SELECT o_orderkey, {_sql('o_orderkey', [0, 0, 1, 1, 0, 1])} = 1 AS garbled, '[' || array_to_string(list_transform(range(0, least(o_orderkey % 4, o_custkey % 3)::BIGINT), lambda i: i || ':' || (i + 5)), ', ') || ']' AS pairs,
 o_orderkey % 120 >= 80 AND (o_orderkey % 120) * 4 >= 400 AS video_ok, o_orderkey % 300 >= 120 AND o_orderkey % 300 >= least(o_custkey * 10 // 12, 240) AS capture_ok, 'p' || chr(10) || chr(10) || o_orderkey AS request FROM orders""")
def reading_checks(spark, sf_dir):
    """Garbled pages, pairs by position, which narrations may stand, and what is asked for one."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    numbers = lambda n, d: F.transform(F.slice(F.array(*[F.lit(i) for i in range(4)]), F.lit(1), n.cast("int")), lambda x: x + d)
    pairs = F.transform(sequences.zip_positions(numbers(o % 4, 0), numbers(c % 3, 5)), lambda x: F.concat(x["0"].cast("string"), F.lit(":"), x["1"].cast("string")))
    narrated = lambda n: F.concat(F.lit(" "), F.repeat(F.lit("y"), n.cast("int")), F.lit("\n"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", sequences.garbled(_pick("o_orderkey", _SHOWN), _pick("o_orderkey", _LOST)).alias("garbled"), F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]")).alias("pairs"),
        media.narration_usable(narrated(o % 120), F.repeat(F.lit("z"), F.lit(400))).alias("video_ok"), capture_report.narration_usable(narrated(o % 300), size=c * 10).alias("capture_ok"),
        media.narration_request(F.lit("  p \n"), o.cast("string")).alias("request"),
    )


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 12")
def last_lines(spark, sf_dir):
    """The last twelve lines of each log."""
    return sequences.last_k(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 12)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(length(event_type)) OVER (PARTITION BY user_id ORDER BY event_id) - length(event_type) AS before FROM events) WHERE before <= 60")
def text_budget(spark, sf_dir):
    """Rows in order until their sizes pass the budget; the one that passes it is kept."""
    return sequences.within_budget(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.length("event_type"), 60).select("user_id", "event_id")


@query("""SELECT user_id, event_id, CASE WHEN before >= 60 THEN chr(10) || '--- log truncated: 60 bytes reached ---' ELSE event_type END AS line FROM (
 SELECT *, coalesce(lag(before) OVER (PARTITION BY user_id ORDER BY event_id) >= 60, false) AS was FROM (SELECT user_id, event_id, event_type, sum(length(event_type) + 1) OVER (PARTITION BY user_id ORDER BY event_id) - length(event_type) - 1 AS before FROM events)) WHERE NOT was""")
def log_capped(spark, sf_dir):
    """A log that ends in one note once its bytes are used up."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("line"))
    return sequences.capped_log(rows, "user_id", "event_id", "line", 60)


@query("""SELECT s_nationkey, string_agg(CASE WHEN bad THEN CASE WHEN starts THEN CASE WHEN a = b THEN '[Page ' || a ELSE '[Pages ' || a || ' to ' || b END || ' could not be read: the fonts used there do not say what their letters are.]' ELSE '' END || CASE WHEN starts AND t <> '' THEN chr(10) || chr(10) ELSE '' END || t ELSE t END, chr(10) || chr(10) ORDER BY page) AS text FROM (
 SELECT *, min(page) OVER g AS a, max(page) OVER g AS b, page = min(page) OVER g AS starts FROM (SELECT *, page - row_number() OVER (PARTITION BY s_nationkey, bad ORDER BY page) AS island FROM (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS page, s_suppkey % 3 = 0 AS bad, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE s_name END AS t FROM supplier)) WINDOW g AS (PARTITION BY s_nationkey, bad, island))
WHERE NOT (bad AND NOT starts AND t = '') GROUP BY s_nationkey""")
def pages_together(spark, sf_dir):
    """Pages in order, a marker before each run of garbled ones."""
    s = read(spark, sf_dir, "supplier")
    page = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    pages = s.select("s_nationkey", page.alias("page_no"), (F.col("s_suppkey") % 3 == 0).alias("garbled"), F.when(F.col("s_suppkey") % 6 == 0, F.lit("")).otherwise(F.col("s_name")).alias("text"))
    return sequences.assemble_pages(pages, "s_nationkey")


_CHAIN = [text.Rule(x, y, whole) for x, y, whole in (("the", "a", True), (" ", "never", True), ("of", "from", True), ("a", "one", True), ("qu", "kw", False), ("der", "jener", True), ("les", "des", True), ("des", "ces", True), ("y", "ie", False), ("zz", "s", False))]


def _chained() -> str:
    """Whole words and parts of words, rule by rule; a match that begins with a capital gives one."""
    t = "coalesce(text, '')"
    word, other = r"[\p{L}\p{N}''’]+", r"[^\p{L}\p{N}''’]+"
    for r in _CHAIN:
        if not r.find.strip():
            continue
        big = r.to[:1].upper() + r.to[1:]
        cut = f"regexp_extract_all({t}, '{word}|{other}')" if r.whole_word else f"regexp_extract_all({t}, '(?i:{r.find})|{r.find[0]}|{r.find[0].upper()}|[^{r.find[0]}{r.find[0].upper()}]+')"
        t = f"array_to_string(list_transform({cut}, lambda x: CASE WHEN lower(x) = '{r.find}' THEN CASE WHEN upper(x[1]) = x[1] THEN '{big}' ELSE '{r.to}' END ELSE x END), '')"
    return t


@query(f"SELECT doc_id, {_chained()} AS said FROM documents")
def replace_chain(spark, sf_dir):
    """Ten rules in turn, of whole words and of parts; the blank one is not used."""
    said, _ = text.replace(F.coalesce("text", F.lit("")), _CHAIN)
    return read(spark, sf_dir, "documents").select("doc_id", said.alias("said"))


@query(r"""WITH RECURSIVE w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS find FROM documents),
r AS (SELECT find, coalesce(lead(find) OVER (PARTITION BY left(find, 1) ORDER BY find), '') AS said, md5(find) AS position FROM w WHERE md5(find) < '1'),
c AS (SELECT find AS start, said, position, 1 AS n FROM r UNION ALL SELECT c.start, r.said, r.position, c.n + 1 FROM c JOIN r ON r.find = c.said AND r.position > c.position),
f AS (SELECT start, arg_max(said, n) AS said, max(n) AS n FROM c GROUP BY start),
d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+') AS words FROM documents),
t AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT row, string_agg(CASE WHEN f.start IS NULL THEN word WHEN lower(word[1]) <> word[1] THEN upper(f.said[1]) || f.said[2:] ELSE f.said END, '' ORDER BY i) AS said, sum(n) AS made FROM t LEFT JOIN f ON f.start = lower(word) GROUP BY row)
SELECT doc_id, coalesce(g.said, '') AS said, coalesce(g.made, 0)::BIGINT AS made FROM d LEFT JOIN g USING (row)""")
def replace_table(spark, sf_dir):
    """One in 16 of the words is a rule of a table, to the next such word or away, in an order of no meaning, so that rules build on rules."""
    documents = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = documents.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("find")).distinct().withColumn("position", F.md5("find")).filter("position < '1'")
    rules = words.select("position", "find", F.lead("find").over(Window.partitionBy(F.left("find", F.lit(1))).orderBy("find")).alias("to"), F.lit(True).alias("whole_word"))
    return replacements.replaced(documents, "text", rules, written).drop("text")


@query("SELECT p_partkey, CASE WHEN p_partkey % 100 = 0 THEN 'now ' ELSE '' END || p_name || p_partkey AS result, p_partkey % 100 <> 0 AS reused FROM part")
def results_reused(spark, sf_dir):
    """A second run over the parts, of which one in a hundred has changed: that one is made, the others come from the store."""
    parts, store = read(spark, sf_dir, "part"), shared_folder(spark)
    text = F.concat("p_name", F.col("p_partkey").cast("string"))
    changed = F.when(F.col("p_partkey") % 100 == 0, F.concat(F.lit("now "), text)).otherwise(text)
    run = lambda said: reuse.results(parts.select("p_partkey", said.alias("text"), F.sha2(said, 256).alias("fingerprint")), lambda df: df.select("fingerprint", F.col("text").alias("result")), store)
    run(text)
    return run(changed).select("p_partkey", "result", "reused")
