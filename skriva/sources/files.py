"""Files by kind, text in several encodings, delimited tables, line-based lists and JSON answers.

Inputs are rows of (path, content), as Spark's binaryFile source gives them. A file that can't be read gives a
row with an error, so one bad file doesn't fail a job.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import heading, phrase, tidy

#: Kinds by extension, and the size limit of text and tables (fixed values).
KINDS = {
    "text": ("txt", "text", "md", "markdown", "log"), "docx": ("docx",), "pdf": ("pdf",), "csv": ("csv", "tsv"), "pptx": ("pptx",), "pcap": ("pcap", "pcapng", "cap"),
    "image": ("png", "jpg", "jpeg", "heic", "heif"), "video": ("mp4", "mov", "m4v", "mkv", "avi", "webm"),
}
MOST_TEXT = 64 << 20
#: 0x80 to 0x9F of Windows-1252; the five that are undefined stay controls (fixed values).
_HIGH = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def kind_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for k, exts in KINDS.items() for e in exts for x in (e, k)]), ext)


def refusal(path: Column) -> Column:
    """Why a file is refused, null if it isn't."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    old = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)) == "ppt"
    return F.when(old, F.lit("this is the old PowerPoint format: save it again as .pptx")).when(kind_of(path).isNull(), F.concat(name, F.lit(" is not a file type this app can read")))


def decode(content: Column | str) -> Column:
    """Bytes to text, natively: UTF-16 or UTF-8 by their mark, else UTF-8 if valid, else Windows-1252.

    An odd last byte of UTF-16 is dropped. What isn't valid UTF-16 gets replacement characters.
    """
    b = F.col(content) if isinstance(content, str) else content
    rest = F.substring(b, 3, 2**31 - 1)
    body = F.substr(rest, F.lit(1), F.floor(F.length(rest) / 2).cast("int") * 2)
    high = "".join(chr(c) for c in range(0x80, 0xA0))
    old = F.translate(F.decode(b, "ISO-8859-1"), high, _HIGH)
    return (
        F.when(F.hex(F.substring(b, 1, 2)) == "FFFE", F.decode(body, "UTF-16LE"))
        .when(F.hex(F.substring(b, 1, 2)) == "FEFF", F.decode(body, "UTF-16BE"))
        .when(F.hex(F.substring(b, 1, 3)) == "EFBBBF", F.decode(F.substring(b, 4, 2**31 - 1), "UTF-8"))
        .when(F.is_valid_utf8(b.cast("string")), b.cast("string"))
        .otherwise(old)
    )


def read_text(files: DataFrame) -> DataFrame:
    """path, text, error of text files, tidied."""
    big = F.length("content") > MOST_TEXT
    return files.select("path", F.when(~big, tidy(decode("content"))).alias("text"), F.when(big, F.lit("too large")).alias("error"))


def delimiter_of(text: Column) -> Column:
    """Of comma, semicolon and tab the one most in the first line that isn't blank; of equals the last."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(r"(?U)\S"))
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    count = lambda d: F.length(first) - F.length(F.replace(first, F.lit(d), F.lit("")))
    return F.array_max(F.array(*[F.struct(count(d).alias("n"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(",;\t")]))["d"]


def rows_of(text: str, delimiter: str) -> Iterator[list[str]]:
    """Rows of a delimited text; blank rows are left out, ragged ones kept.

    A quote opens a field only where nothing but blanks precede it, and those go; inside, two quotes are one;
    what follows the closing quote belongs to the field. An open quote takes the rest of the text.
    """
    row: list[str] = []
    field: list[str] = []
    quoted, i, n = False, 0, len(text)

    def end() -> list[str] | None:
        row.append("".join(field))
        field.clear()
        full = [*row]
        row.clear()
        return full if any(c.strip() for c in full) else None

    while i < n:
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                field.append('"')
                i += 1
            elif c == '"':
                quoted = False
            else:
                field.append(c)
        elif c == '"' and not "".join(field).strip():
            field.clear()
            quoted = True
        elif c == delimiter:
            row.append("".join(field))
            field.clear()
        elif c in "\r\n":
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
            if (full := end()) is not None:
                yield full
        else:
            field.append(c)
        i += 1
    if (row or field) and (full := end()) is not None:
        yield full


def read_tables(files: DataFrame) -> DataFrame:
    """path, row_no (0 is the heading), cells and error; any quoting, any row length. A file that is refused is one row with the reason."""
    text = F.regexp_replace(decode("content"), "^﻿", "")

    def parsed(batches):
        from ..functions.arrow import batches_of

        for b in batches:
            for path, text, delimiter in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                yield from batches_of(((path, i, cells) for i, cells in enumerate(rows_of(text or "", delimiter or "\t"))), ["path", "row_no", "cells"], [pa.string(), pa.int64(), pa.list_(pa.string())])

    error = F.when(F.col("content").isNull(), F.lit("cannot be read")).when(F.length("content") > MOST_TEXT, F.lit("too large"))
    told = files.select("path", F.col("content"), error.alias("error"))
    have = told.filter("error is null").select("path", text.alias("text")).withColumn("d", delimiter_of(F.col("text")))
    rows = have.mapInArrow(parsed, "path string, row_no bigint, cells array<string>").withColumn("error", F.lit(None).cast("string"))
    return rows.unionByName(told.filter("error is not null").select("path", "error"), allowMissingColumns=True)


def speak_tables(rows: DataFrame) -> DataFrame:
    """path and text: the table's size, then each row's cells under their headings; files that were refused have none.

    A file's narration is one value; its rows are sorted where they meet, in the file's own group.
    """
    head = rows.filter("row_no = 0").select("path", F.transform("cells", lambda c, i: heading(c, i)).alias("heads"))
    joined = rows.join(head, "path").filter("row_no > 0")
    last = F.expr("aggregate(sequence(1, size(cells)), 0, (a, i) -> if(i <= size(heads) or cells[i - 1] rlike '(?U)\\\\S', i, a))")
    kept = F.slice("cells", 1, F.when(F.size("cells") == 0, 0).otherwise(last))
    said = F.transform(kept, lambda c, i: phrase(F.coalesce(F.get("heads", i), F.concat(F.lit("Column "), (i + 1).cast("string"))), c))
    lines = joined.select("path", "row_no", F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(". "), F.array_join(said, " ")).alias("line"))
    body = lines.groupBy("path").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("all"))
    whole = head.join(body, "path", "left")
    n, m = F.coalesce("n", F.lit(0)), F.size("heads")
    count = lambda c, one: F.when(c == 0, F.lit(f"no {one}s")).when(c == 1, F.lit(f"1 {one}")).otherwise(F.concat(c.cast("string"), F.lit(f" {one}s")))
    start = F.concat(F.lit("Table with "), count(n, "row"), F.lit(" and "), count(m, "column"), F.lit("."))
    only = F.concat(start, F.lit("\n\nThe columns are: "), F.array_join("heads", ", "), F.lit("."))
    return whole.select("path", F.when(n == 0, only).otherwise(F.concat(start, F.lit("\n\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"))).alias("text"))


def voice_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """id, locale, sample of the lines "name   locale # sample"; other lines are left out."""
    shape = r"^(.+?)\s{2,}([A-Za-z]{2,3}[_-][A-Za-z0-9_-]+)\s*(?:#\s*(.*))?$"
    return lines.filter(F.col(column).rlike(shape)).select(F.trim(F.regexp_extract(column, shape, 1)).alias("id"), F.regexp_extract(column, shape, 2).alias("locale"), F.regexp_extract(column, shape, 3).alias("sample"))


def voice_pairs(lines: DataFrame, column: str = "value") -> DataFrame:
    """id and culture of the lines "name TAB culture"."""
    parts = F.split(column, "\t")
    return lines.filter(F.trim(parts[0]) != "").select(F.trim(parts[0]).alias("id"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("culture"))


def frame_time(line: Column) -> Column:
    """Seconds after pts_time: in a decoder's line, null if none, negative or not finite."""
    value = F.regexp_extract(line, r"pts_time:\s*(\S+)", 1).try_cast("double")
    return F.when((value >= 0) & (value < float("inf")), value)


def settings(text: str | None, defaults: dict) -> dict:
    """Settings as JSON over their defaults; anything wrong gives the defaults."""
    try:
        got = json.loads(text or "")
    except ValueError:
        return dict(defaults)
    return defaults | {k: v for k, v in got.items() if k in defaults} if isinstance(got, dict) else dict(defaults)


def place_name(place: Column) -> Column:
    """City, else town, village or municipality, then state and country; else the display name. place: a struct."""
    a = place["address"]
    near = F.coalesce(a["city"], a["town"], a["village"], a["municipality"])
    joined = F.concat_ws(", ", near, a["state"], a["country"])
    return F.coalesce(F.nullif(joined, F.lit("")), place["display_name"])


def model_names(answer: Column) -> Column:
    return F.transform(F.from_json(answer, "models array<struct<name string>>")["models"], lambda m: m["name"])


def has_model(names: Column, wanted: Column) -> Column:
    """Whether a model is there; a name without a tag means the latest."""
    full = F.when(wanted.contains(":"), wanted).otherwise(F.concat(wanted, F.lit(":latest")))
    return F.array_contains(names, full)


def failure(message: Column) -> Column:
    """Class of an engine's failure by what its message holds."""
    memory = message.contains("requires more system memory") | message.contains("available memory")
    return F.when(message.contains("unknown model architecture"), "model too old").when(memory, "memory").otherwise("other")


def wav_samples(content: bytes) -> tuple[int, int, list[int]] | None:
    """(channels, rate, 16-bit samples) of an integer or float WAV file; None if it is neither."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, form, out = 12, None, None
    while at + 8 <= len(content):
        kind, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if kind == b"fmt " and len(body) >= 16:
            form = struct.unpack("<HHIIHH", body[:16])
            if form[0] == 0xFFFE and len(body) >= 26:
                form = (struct.unpack("<H", body[24:26])[0], *form[1:])
        elif kind == b"data" and form:
            import numpy as np

            bits = form[5]
            if form[0] == 3 and bits == 32:
                out = (np.clip(np.frombuffer(body[: len(body) // 4 * 4], "<f4"), -1, 1) * 32767).astype(np.int16)
            elif form[0] == 1 and bits == 8:
                out = ((np.frombuffer(body, np.uint8).astype(np.int16) - 128) << 8).astype(np.int16)
            elif form[0] == 1 and bits == 16:
                out = np.frombuffer(body[: len(body) // 2 * 2], "<i2")
            elif form[0] == 1 and bits == 24:
                raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
                out = (raw[:, 1].astype(np.uint16) | raw[:, 2].astype(np.uint16) << 8).view(np.int16)
            elif form[0] == 1 and bits == 32:
                out = (np.frombuffer(body[: len(body) // 4 * 4], "<i4") >> 16).astype(np.int16)
        at += 8 + size + size % 2
    return None if form is None or out is None else (form[1], form[2], out.tolist())


def read_wav(files: DataFrame) -> DataFrame:
    """path, channels, rate, samples and, if it can't be read, error."""

    def rows(batches):
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = wav_samples(content.as_py() or b"")
                out.append((path, *(got or (None, None, None)), None if got else "not a WAV file of integers or floats"))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int16()), pa.string()), strict=True)], ["path", "channels", "rate", "samples", "error"])

    return files.select("path", "content").mapInArrow(rows, "path string, channels int, rate int, samples array<smallint>, error string")


def write_wav(channels: int, rate: int, samples: list[int]) -> bytes:
    data = struct.pack(f"<{len(samples)}h", *samples)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data" + struct.pack("<I", len(data)) + data
