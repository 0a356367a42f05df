"""Decisions about jobs: engines, names, policies, progress. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import Rule, replace, trim

#: The default model, and the retired one (fixed values); extensions that need no engine to be read.
VISION_MODEL, RETIRED = "qwen2.5vl:3b", "llama3.2-vision"
HEADLESS = ("text", "docx", "pdf", "csv", "pptx")


def is_retired(model: Column) -> Column:
    return F.lower(F.split(F.trim(model), ":")[0]) == RETIRED


def current_model(model: Column) -> Column:
    """A saved model, or the default for a blank or retired one."""
    return F.when((F.trim(F.coalesce(model, F.lit(""))) == "") | is_retired(model), F.lit(VISION_MODEL)).otherwise(model)


def current_prompt(saved: Column, superseded: str, default: str) -> Column:
    """A saved prompt as it is, or the default for a blank or superseded one."""
    said = trim(F.coalesce(saved, F.lit("")))
    return F.when((said == "") | (said == superseded.strip()), F.lit(default)).otherwise(saved)


def current_engine(saved: Column) -> Column:
    """A saved engine; whatever earlier versions wrote beside the cloud's two names means the system's."""
    return F.when(saved.isin("eleven_labs", "elevenlabs"), F.lit("eleven_labs")).otherwise(F.lit("system"))


def engine(saved: Column, has_key: Column, kind: Column, cloud_captures: Column, system_works: Column) -> Column:
    """cloud, system, missing key or unsupported. A capture stays local unless the cloud is allowed for it."""
    system = F.when(system_works, "system").otherwise("unsupported")
    cloud = saved.isin("eleven_labs", "elevenlabs")
    return F.when((kind == "pcap") & ~cloud_captures, system).when(cloud, F.when(has_key, "cloud").otherwise("missing key")).otherwise(system)


def is_voice_id(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_-]+\\z")


def download_url(candidates: Column, page: str) -> Column:
    """The first https address of an array, else the page."""
    return F.coalesce(F.get(F.filter(candidates, lambda u: u.startswith("https://")), F.lit(0)), F.lit(page))


def is_fragment(answer: Column) -> Column:
    """Whether an answer was cut off before it said anything (fixed value: 40 characters)."""
    return F.length(F.regexp_replace(answer, r"(?U)\A\s+|\s+\z", "")) < 40


def unique_names(df: DataFrame, name: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """df with unique: the name where it is first used, else "stem (n).ext" with the next n from 2 that is free.

    A name is taken if a row of df or of existing (one column) has it; so no row gets the name of another. Two
    names never lead to the same numbered one, so a name's numbers depend on the taken ones among its own: the k-th use
    passes by the i-th of those, b, if k > b - i - 1, which a running count over both in one order gives.
    """
    parts = r"(?s)^(.+?)(\.[^.]*)?$"
    stem, ext = F.regexp_extract(name, parts, 1), F.regexp_extract(name, parts, 2)
    taken = df.select(name) if existing is None else df.select(name).union(existing)
    there = taken.select(F.col(name).alias("__was")).distinct()
    # a taken "stem (n).ext" with n from 2, written as it would be made, blocks n for "stem.ext"
    made = r"(?s)^(.*) \(([1-9][0-9]{0,17})\)(\.[^.]*)?$"
    blocked = there.select(F.concat(F.regexp_extract("__was", made, 1), F.regexp_extract("__was", made, 3)).alias(name), F.regexp_extract("__was", made, 2).try_cast("bigint").alias("__b"), "__was")
    blocked = blocked.filter((F.col("__b") > 1) & (F.concat(stem, F.lit(" ("), F.col("__b").cast("string"), F.lit(")"), ext) == F.col("__was")))
    i = F.row_number().over(Window.partitionBy(name).orderBy("__b"))
    blocked = blocked.select(name, (F.col("__b") - i - 1).alias("__at"), F.lit(1).alias("__blocks"))
    uses = df.withColumn("__k", F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1)
    if existing is not None:
        old = existing.toDF(name).distinct().withColumn("__old", F.lit(1))
        uses = uses.join(old, name, "left").withColumn("__k", F.col("__k") + F.coalesce("__old", F.lit(0))).drop("__old")
    line = uses.withColumn("__at", F.col("__k") - 1).withColumn("__blocks", F.lit(0)).unionByName(blocked, allowMissingColumns=True)
    passed = F.sum("__blocks").over(Window.partitionBy(name).orderBy("__at", F.desc("__blocks")).rowsBetween(Window.unboundedPreceding, 0))
    n = (F.col("__k") + 1 + F.col("__passed")).cast("string")
    unique = F.when(F.col("__k") == 0, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), n, F.lit(")"), ext))
    return line.withColumn("__passed", passed).filter("__blocks = 0").withColumn("unique", unique).select(*df.columns, "unique")


def system_language(*settings: Column) -> Column:
    """The first setting that names a language, without its encoding; C and POSIX name none."""
    tags = [F.trim(F.split(s, r"\.")[0]) for s in settings]
    return F.coalesce(*[F.when((t != "") & ~t.isin("C", "POSIX"), F.replace(t, F.lit("_"), F.lit("-"))) for t in tags])


def voice_detail(accent: Column, description: Column, category: Column) -> Column:
    """Accent and description, underscores as spaces; else the category."""
    said = F.replace(F.concat_ws(", ", F.nullif(accent, F.lit("")), F.nullif(description, F.lit(""))), F.lit("_"), F.lit(" "))
    return F.coalesce(F.nullif(said, F.lit("")), category)


def is_untouched(prompts: DataFrame, defaults: DataFrame) -> DataFrame:
    """The prompts that are blank or, trimmed, some language's default (both: column prompt)."""
    known = defaults.select(F.col("prompt").alias("__known")).distinct()
    blank = prompts.withColumn("__trimmed", trim("prompt"))
    return blank.join(known.withColumn("__hit", F.lit(True)), F.col("__trimmed") == F.col("__known"), "left").filter((F.col("__trimmed") == "") | F.col("__hit")).select(*prompts.columns)


def settings(saved: Column, defaults: dict[str, str]) -> Column:
    """A map of settings: the saved JSON object over the defaults; without one, the defaults. Unknown names go."""
    got = F.from_json(saved, "map<string,string>")
    return F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.coalesce(F.try_element_at(got, F.lit(k)), F.lit(v)))])


def api_key(environment: Column, stored: Column) -> Column:
    """The key of the environment if it isn't blank, else the stored one; trimmed, null if there is none."""
    some = lambda c: F.nullif(trim(c), F.lit(""))
    return F.coalesce(some(environment), some(stored))


def kept_voice(saved: Column, voices: Column) -> Column:
    """The saved voice if it is among the voices, else the first of them, else the saved one."""
    return F.when(F.array_contains(voices, saved), saved).otherwise(F.coalesce(F.get(voices, F.lit(0)), saved))


def speech(text: Column, note: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text to speak, replacements made): the text, then the engine's note if there is one, then the rules over both."""
    whole = F.when(note.isNull(), text).otherwise(F.concat(text, F.lit("\n\n"), note))
    return replace(whole, rules)


def extracted(name: Column, text: Column, caveat: Column) -> Column:
    """What a reader gives back: text, and the note that tells how long it is and what to beware of."""
    size = F.concat(name, F.lit(": "), F.length(text).cast("string"), F.lit(" characters"))
    return F.struct(text.alias("text"), F.concat(size, F.coalesce(F.concat(F.lit(" · "), caveat), F.lit(""))).alias("note"))


def write_extracted(df: DataFrame, path: str) -> None:
    """Rows of (path, text, caveat) as a table with text and note; a job's output is the same whatever its reader was."""
    out = df.select("path", extracted(F.element_at(F.split("path", r"[/\\]"), -1), F.col("text"), F.col("caveat")).alias("x"))
    out.select("path", "x.*").write.parquet(path)


def progress(part: Column, parts: Column, inside: Column) -> Column:
    return (part + F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside))) / parts


def rewind(position: Column, seconds: float = 10) -> Column:
    return F.greatest(position - seconds, F.lit(0.0))


def samples(values: Column) -> Column:
    """Floats to 16-bit samples: clamped, scaled, truncated."""
    return F.transform(values, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("smallint"))


def fingerprint(*fields: Column) -> Column:
    """Hash of what a spoken result depends on: text, disclosure, rules, engine."""
    return F.sha2(F.to_json(F.struct(*[f.cast("string").alias(f"f{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


