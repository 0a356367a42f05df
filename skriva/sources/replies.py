"""Replies of services as lines of JSON whose shape varies from line to line, read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jobs
from ..functions.text import trim

#: What tells a shape, in this order: the first field that a line has.
SHAPES = {"error": "error", "models": "models", "voices": "voices", "tag_name": "release", "address": "place", "display_name": "place", "response": "reply", "done_reason": "reply", "status": "progress"}


def read_replies(lines: DataFrame, column: str = "line", platform: str = "") -> DataFrame:
    """lines without blank ones, with kind and what is read of that kind; the columns of other kinds are null.

    kind: error, models, voices, release, place, reply, progress; other for JSON of no known shape, broken for what is no JSON
    (cut or garbled lines), so each line that isn't blank is a row. A field of the wrong type is as if it weren't there.

    error: its message. models: names. voices: id, name, detail, by lower-case name. release: version without v, notes and the
    first https address of the asset whose name begins with platform and of the page. place: its name. reply: trimmed
    text, whether it was cut short, and tokens. progress: status, and the fraction done where the total is known.
    """
    if clash := {"kind", *SHAPES.values()} & set(lines.columns):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    rows = lines.filter(F.col(column).rlike(r"(?U)\S")).withColumn("__v", F.try_parse_json(column))
    get = lambda path, kind="string": F.try_variant_get(F.col("__v"), f"$.{path}", kind)
    known = F.coalesce(*[F.when(get(field, "variant").isNotNull() & ~F.is_variant_null(get(field, "variant")), F.lit(kind)) for field, kind in SHAPES.items()], F.lit("other"))
    kind = F.when(F.col("__v").isNull(), "broken").otherwise(known)
    rows = rows.withColumn("kind", kind)
    only = lambda kind, value: F.when(F.col("kind") == kind, value).alias(kind)

    number = lambda path: get(path, "long")
    fraction = F.when(number("total") > 0, number("completed") / number("total")).cast("float")
    tokens = F.struct(trim(F.coalesce(get("response"), F.lit(""))).alias("text"), F.coalesce(get("done_reason") == "length", F.lit(False)).alias("truncated"), number("prompt_eval_count").alias("prompt_tokens"), number("eval_count").alias("answer_tokens"))
    url = _https(get("assets", "array<struct<name:string,browser_download_url:string>>"), get("html_url"), platform)
    release = F.struct(F.regexp_replace(get("tag_name"), "^v+", "").alias("version"), F.coalesce(get("body"), F.lit("")).alias("notes"), url.alias("url"))
    address = get("address", "struct<city:string,town:string,village:string,municipality:string,state:string,country:string>")
    near = F.coalesce(address["city"], address["town"], address["village"], address["municipality"])
    place = F.coalesce(F.nullif(F.concat_ws(", ", near, address["state"], address["country"]), F.lit("")), get("display_name"))
    return rows.select(
        *lines.columns, "kind", only("error", get("error")), only("models", F.transform(get("models", "array<struct<name:string>>"), lambda m: m["name"])), only("voices", _voices(get("voices", "array<variant>"))),
        only("release", release), only("place", place), only("reply", tokens), only("progress", F.struct(F.coalesce(get("status"), F.lit("")).alias("status"), fraction.alias("fraction"))),
    )


def _https(assets: Column, page: Column, platform: str) -> Column:
    ours = F.get(F.filter(assets, lambda a: a["name"].startswith(platform)), F.lit(0))["browser_download_url"] if platform else F.lit(None).cast("string")
    return F.get(F.filter(F.array(ours, page), lambda u: u.startswith("https://")), F.lit(0))


def _voices(entries: Column) -> Column:
    def voice(v, i):
        of = lambda path: F.try_variant_get(v, f"$.{path}", "string")
        name = F.coalesce(of("name"), F.lit(""))
        detail = jobs.voice_detail(of("labels.accent"), of("labels.descriptive"), F.coalesce(of("category"), F.lit("")))
        return F.struct(F.lower(name).alias("by"), i.alias("i"), of("voice_id").alias("id"), name.alias("name"), detail.alias("detail"))

    voices = F.filter(F.transform(entries, voice), lambda v: v["id"].isNotNull())
    return F.transform(F.array_sort(voices), lambda v: F.struct(v["id"].alias("id"), v["name"].alias("name"), v["detail"].alias("detail")))


def downloads(replies: DataFrame, by: str, order: str) -> DataFrame:
    """by, status and fraction of the last progress, and the error that ended it: what comes after the first error isn't seen.

    Errors are found first and are few; then each download is one aggregate, partial before its shuffle.
    """
    of = replies.filter("kind in ('progress', 'error')")
    ended = of.filter("kind = 'error'").groupBy(by).agg(F.min(order).alias("__end"), F.min_by("error", order).alias("error"))
    seen = of.filter("kind = 'progress'").withColumnRenamed(by, "__by").join(ended.withColumnRenamed(by, "__of"), F.expr("__by <=> __of"), "left").filter(F.col("__end").isNull() | (F.col(order) < F.col("__end")))
    last = seen.groupBy(F.col("__by")).agg(F.max_by("progress", order).alias("__last"))
    whole = last.join(ended.withColumnRenamed(by, "__of"), F.expr("__by <=> __of"), "full")
    return whole.select(F.coalesce("__by", "__of").alias(by), F.col("__last.status").alias("status"), F.col("__last.fraction").alias("fraction"), "error")
