"""Runs, samples and matches over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_ascii, natural_key

#: A page is garbled from so many lost glyphs and so many percent (fixed values); tracks of one archive.
GLYPHS, PERCENT, TRACKS, TRACK_BYTES = 32, 25, 500, 256 << 20
PLAYABLE = ("mp3", "wav", "wave")
#: Colours by name (fixed values); the first of equally near ones counts, black says nothing.
COLOURS = {
    "black": 0x000000, "white": 0xFFFFFF, "grey": 0x808080, "red": 0xFF0000, "dark red": 0x8B0000, "orange": 0xFFA500, "yellow": 0xFFFF00,
    "green": 0x008000, "light green": 0x90EE90, "blue": 0x0000FF, "dark blue": 0x00008B, "light blue": 0xADD8E6, "purple": 0x800080,
    "pink": 0xFFC0CB, "brown": 0xA52A2A, "teal": 0x008080,
}


def garbled(kept: Column, dropped: Column) -> Column:
    return (dropped >= GLYPHS) & (dropped * 100 >= (kept + dropped) * PERCENT)


def runs(df: DataFrame, flag: str, by: str, order: str) -> DataFrame:
    """by, first and last of each run of neighbouring rows whose flag holds (gaps and islands)."""
    w = Window.partitionBy(by).orderBy(order)
    starts = (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    marked = df.withColumn("__run", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter(F.col(flag)).groupBy(by, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("__run")


def page_marker(first: Column, last: Column) -> Column:
    pages = F.when(first == last, F.concat(F.lit("Page "), first.cast("string"))).otherwise(F.concat(F.lit("Pages "), first.cast("string"), F.lit(" to "), last.cast("string")))
    return F.concat(F.lit("["), pages, F.lit(" could not be read: the fonts used there do not say what their letters are.]"))


def assemble_pages(pages: DataFrame, by: str = "path") -> DataFrame:
    """by and text: pages in order, blank ones left out, each run of garbled pages after its marker."""
    w = Window.partitionBy(by).orderBy("page_no")
    starts = F.col("garbled") & ~F.coalesce(F.lag("garbled").over(w), F.lit(False))
    numbered = pages.withColumn("__run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__starts", starts)
    last = F.max(F.when(F.col("garbled"), F.col("page_no"))).over(Window.partitionBy(by, "__run"))
    parts = numbered.select(by, "page_no", F.when(F.col("__starts"), page_marker(F.col("page_no"), last)).alias("mark"), "text")
    both = F.filter(F.array("mark", "text"), lambda t: t.isNotNull() & t.rlike(r"(?U)\S"))
    rows = parts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("page_no", both.alias("t")))).alias("all"))
    return rows.select(by, F.array_join(F.flatten(F.transform("all", lambda x: x["t"])), "\n\n").alias("text"))


def ranges(df: DataFrame, by: str, number: str) -> DataFrame:
    """by and said: the numbers as page runs, "pages 3, 8 and 9, 27–41"."""
    w = Window.partitionBy(by).orderBy(number)
    island = df.select(by, number, (F.col(number) - F.row_number().over(w)).alias("__i")).groupBy(by, "__i").agg(F.min(number).alias("a"), F.max(number).alias("b"), F.count("*").alias("n"))
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    text = F.when(F.col("a") == F.col("b"), a).when(F.col("b") - F.col("a") == 1, F.concat(a, F.lit(" and "), b)).otherwise(F.concat(a, F.lit("–"), b))
    rows = island.groupBy(by).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("a", text.alias("t")))).alias("all"))
    head = F.when(F.col("n") == 1, F.lit("page ")).otherwise(F.lit("pages "))
    return rows.select(by, F.concat(head, F.array_join(F.transform("all", lambda x: x["t"]), ", ")).alias("said"))


def nearest_colour(rgb: Column) -> Column:
    """Name of the nearest colour to 0xRRGGBB, null for black or what isn't a colour."""
    part = lambda c, s: F.shiftright(c, s).bitwiseAND(255)
    far = lambda v: sum(((part(rgb, s) - ((v >> s) & 255)) * (part(rgb, s) - ((v >> s) & 255)) for s in (16, 8, 0)), F.lit(0))
    best = F.array_min(F.array(*[F.struct(far(v).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, v) in enumerate(COLOURS.items())]))["name"]
    return F.when((rgb >= 0) & (rgb <= 0xFFFFFF) & (best != "black"), best)


def zip_positions(a: Column, b: Column) -> Column:
    """Pairs by position, as many as the shorter has."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(F.arrays_zip(a, b), 1, n)


def playable_entries(entries: DataFrame, most: int | None = TRACKS) -> DataFrame:
    """Archive entries that can be played: contained names, no litter, a known extension, claimed size in bounds; so many in archive order, None for all."""
    parts, base = F.split("path", "[/\\\\]"), F.element_at(F.split("path", "[/\\\\]"), -1)
    litter = F.array_contains(parts, "__MACOSX") | base.startswith("._") | (base == ".DS_Store")
    contained = ~F.array_contains(parts, "..") & ~F.col("path").startswith("/") & ~F.col("path").rlike("^[A-Za-z]:")
    ok = entries.filter(~F.col("path").endswith("/") & contained & ~litter & F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1)).isin(*PLAYABLE) & (F.col("size") <= TRACK_BYTES))
    if most is None:
        return ok
    return ok.withColumn("__n", F.row_number().over(Window.partitionBy("archive").orderBy("entry_index"))).filter(F.col("__n") <= most).drop("__n")


def arrange(candidates: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks in running order, names of the manifest that are missing).

    Names match by base name without regard to the case of A-Z, one entry to one file, both in order: the k-th
    use of a name takes its k-th file. Listed tracks come first, by position (none last), then the others in
    natural order.
    """
    base = lambda c: fold_ascii(F.element_at(F.split(c, "[/\\\\]"), -1))
    listed = Window.partitionBy("archive").orderBy(F.col("pos").asc_nulls_last(), "line")
    wanted = manifest.withColumn("key", base("name")).withColumn("at", F.row_number().over(listed)).filter(F.col("at") <= TRACKS)
    wanted = wanted.withColumn("k", F.row_number().over(Window.partitionBy("archive", "key").orderBy("at")))
    natural = natural_key("path")
    have = candidates.withColumn("key", base("path")).withColumn("natural", natural)
    have = have.withColumn("k", F.row_number().over(Window.partitionBy("archive", "key").orderBy("natural", "entry_index")))
    on = ["archive", "key", "k"]
    found = wanted.join(have, on).select("archive", F.lit(0).alias("part"), "at", F.lit(None).cast("array<string>").alias("natural"), "path", "entry_index", "kind")
    rest = have.join(wanted, on, "left_anti").select("archive", F.lit(1).alias("part"), F.lit(0).alias("at"), "natural", "path", "entry_index", F.lit("unlisted").alias("kind"))
    order = Window.partitionBy("archive").orderBy("part", "at", "natural", "entry_index")
    tracks = found.unionByName(rest).withColumn("track_no", F.row_number().over(order)).filter(F.col("track_no") <= TRACKS)
    missing = wanted.join(have, on, "left_anti").select("archive", "line", "name")
    return tracks.select("archive", "track_no", "path", "kind", "entry_index"), missing


def overlap_schedule(tracks: DataFrame, overlap_ms: int = 1250) -> DataFrame:
    """Start of each track in ms: music after speech of known length begins so long before the speech ends."""
    w = Window.partitionBy("archive").orderBy("track_no")
    early = F.when((F.lag("kind").over(w) == "speech") & (F.col("kind") == "music") & F.lag("ms").over(w).isNotNull(), F.least(F.lit(overlap_ms), F.lag("ms").over(w))).otherwise(0)
    told = tracks.withColumn("__early", early)
    before = F.coalesce(F.sum("ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return told.withColumn("start_ms", before - F.sum("__early").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__early")


def last_k(df: DataFrame, by: str, order: str, k: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("__n") <= k).drop("__n")


def within_budget(df: DataFrame, by: str, order: str, size: Column, most: int) -> DataFrame:
    """Rows in order until their sizes pass `most`; the row that passes it is kept."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__before", before).filter(F.col("__before") <= most).drop("__before")


def capped_log(df: DataFrame, by: str, order: str, line: str, most: int) -> DataFrame:
    """Lines in order until `most` bytes are written (a line break each), then one note in place of all others."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.coalesce(F.sum(F.octet_length(line) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = df.withColumn("__over", before >= most).withColumn("__was", F.coalesce(F.lag("__over").over(w), F.lit(False)))
    note = F.lit(f"\n--- log truncated: {most} bytes reached ---")
    return told.filter(~F.col("__was")).withColumn(line, F.when(F.col("__over"), note).otherwise(F.col(line))).drop("__over", "__was")
