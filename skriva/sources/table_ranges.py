"""Delimited files of any size, cut at any byte, with the rows that one reader from the start would give.

Whether a line break ends a row depends on every quote before it. So each range first runs the quoting automaton from all
its states at once: what it leaves is a map from the state before the range to the state behind it. Composed in order
(maps compose associatively), they give the state in which each range begins. A row belongs to the range that holds the
line break before it, the first row to the first range; a row that goes on beyond the range is read to its end there.

Files are opened by the executors, by a path they all see. A file is UTF-16 by its mark, else UTF-8 if all of it is
valid, else Windows-1252; the delimiter is that of its first line that isn't blank, as for whole files.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrow import batches_of
from .capture_ranges import tasks
from .files import _HIGH, rows_of

RANGE = 64 << 20
#: Bytes read at once beyond a range.
AHEAD = 1 << 16
# states: a field that is blank so far, one that isn't, the same two within quotes, and behind a quote within quotes
BLANK, OPEN, Q_BLANK, Q_OPEN, E_BLANK, E_OPEN = range(6)
START = tuple(range(6))
_HIGH_OF = {0x80 + i: c for i, c in enumerate(_HIGH)}
_CODECS = {"utf-16-le": 2, "utf-16-be": 2, "utf-8": 1, "latin-1": 1}


def step(state: int, kind: str, blank_delimiter: bool) -> int:
    """kind: one of quote, delimiter, line, blank (white space) and other."""
    if state in (Q_BLANK, Q_OPEN):
        if kind == "quote":
            return E_BLANK if state == Q_BLANK else E_OPEN
        stays = kind in ("line", "blank") or kind == "delimiter" and blank_delimiter
        return state if stays else Q_OPEN
    if state in (E_BLANK, E_OPEN):
        if kind == "quote":
            return Q_OPEN
        state = BLANK if state == E_BLANK else OPEN
    if kind == "quote":
        return Q_BLANK if state == BLANK else OPEN
    if kind in ("delimiter", "line"):
        return BLANK
    return OPEN if kind == "other" else state


class Quoting:
    """The automaton of one delimiter over tokens; maps are met again and again, so each step from a map is kept."""

    def __init__(self, delimiter: str):
        self.delimiter, self.token = delimiter, re.compile(f'["\\r\\n{re.escape(delimiter)}]|[^"\\r\\n{re.escape(delimiter)}]+')
        self.known: dict[tuple, tuple] = {}

    def kind(self, token: str) -> str:
        if token == '"':
            return "quote"
        if token == self.delimiter:
            return "delimiter"
        return "line" if token in "\r\n" else "other" if token.strip() else "blank"

    def map(self, text: str, maps: tuple = START) -> tuple:
        for m in self.token.finditer(text):
            key = maps, self.kind(m[0])
            if (after := self.known.get(key)) is None:
                after = self.known[key] = tuple(step(s, key[1], self.delimiter.isspace()) for s in maps)
            maps = after
        return maps

    def breaks(self, text: str, state: int) -> Iterator[int]:
        """Where the line breaks that end rows are."""
        blank = self.delimiter.isspace()
        for m in self.token.finditer(text):
            kind = self.kind(m[0])
            if kind == "line" and state not in (Q_BLANK, Q_OPEN):
                yield m.start()
            state = step(state, kind, blank)


def cut(f, at: int, codec: str) -> int:
    """The first character that begins at or behind a byte."""
    if codec in ("utf-16-le", "utf-16-be"):
        at += at % 2
        f.seek(at)
        unit = f.read(2)
        low = len(unit) == 2 and 0xDC00 <= int.from_bytes(unit, "little" if codec == "utf-16-le" else "big") < 0xE000
        return at + 2 * low
    if codec == "utf-8":
        f.seek(at)
        for b in f.read(3):
            if b & 0xC0 != 0x80:
                break
            at += 1
    return at


def decoded(data: bytes, codec: str) -> str:
    if codec == "latin-1":
        return data.decode("latin-1").translate(_HIGH_OF)
    return data[: len(data) // 2 * 2].decode(codec, "replace") if codec != "utf-8" else data.decode("utf-8", "replace")


def span(f, start: int, stop: int, size: int, codec: str) -> tuple[int, int]:
    """A range with its ends moved to whole characters; both sides of an end move it alike."""
    return cut(f, start, codec) if start else 0, size if stop >= size else min(cut(f, stop, codec), size)


def _first_line(f, codec: str, mark: int) -> str:
    """The first line that isn't blank."""
    f.seek(mark)
    held = b""
    while True:
        data = f.read(AHEAD)
        held += data
        whole = held[: len(held) // 2 * 2] if codec.startswith("utf-16") else held
        lines = re.split(r"\r\n|\r|\n", whole.decode(codec, "ignore"))
        for line in lines[: len(lines) if not data else -1]:
            if line.strip():
                return line
        if not data:
            return ""


def read_tables(spark: SparkSession, path: str, size: int = RANGE, write=None) -> DataFrame:
    """path, row_no (0 is the heading), cells of all files at path, read in ranges of size bytes; a blank file has no rows.

    write: makes a table of rows that lasts; by default a checkpoint.
    """
    write = write or (lambda df: df.checkpoint())
    found = sorted(p for p in glob.glob(os.path.join(path, "**"), recursive=True) if os.path.isfile(p)) if os.path.isdir(path) else sorted(glob.glob(path))
    files = spark.createDataFrame([(p, os.path.getsize(p)) for p in found], "path string, size bigint").filter("size > 0")
    parts = files.select("path", "size", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(size).cast("bigint"))).alias("i", "start")).withColumn("stop", F.least(F.col("start") + size, "size"))
    parts = parts.repartition(tasks(spark, [os.path.getsize(p) for p in found], size), "path", "i")

    def looked(batches):
        def rows():
            for b in batches:
                for r in b.to_pylist():
                    with open(r["path"], "rb") as f:
                        head, codec, lines = f.read(3), None, [None, None]
                        mark = 2 if head[:2] in (b"\xff\xfe", b"\xfe\xff") else 3 if head == b"\xef\xbb\xbf" else 0
                        if mark == 2:
                            codec = "utf-16-le" if head[:1] == b"\xff" else "utf-16-be"
                        elif mark == 3:
                            codec = "utf-8"
                        begin, end = span(f, r["start"], r["stop"], r["size"], "utf-8")
                        f.seek(begin)
                        valid = True
                        if codec is None:
                            try:
                                f.read(end - begin).decode("utf-8")
                            except UnicodeDecodeError:
                                valid = False
                        if r["i"] == 0:
                            lines = [_first_line(f, codec or c, mark) for c in ("utf-8", "latin-1")]
                    yield (r["path"], codec, mark, valid, *lines)

        yield from batches_of(rows(), ["path", "codec", "mark", "valid", "line", "old_line"], [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()], 64)

    facts = parts.mapInArrow(looked, "path string, codec string, mark bigint, valid boolean, line string, old_line string").groupBy("path").agg(F.first("codec").alias("codec"), F.first("mark").alias("mark"), F.bool_and("valid").alias("valid"), F.max("line").alias("line"), F.max("old_line").alias("old_line"))
    line = F.when(F.col("codec").isNotNull() | F.col("valid"), F.col("line")).otherwise(F.col("old_line"))
    count = lambda d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    delimiter = F.array_max(F.array(*[F.struct(count(d).alias("n"), F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(",;\t")]))["d"]
    facts = write(facts.select("path", "mark", F.coalesce("codec", F.when(F.col("valid"), "utf-8").otherwise("latin-1")).alias("codec"), delimiter.alias("delimiter")))

    def mapped(batches):
        def rows():
            for b in batches:
                for r in b.to_pylist():
                    with open(r["path"], "rb") as f:
                        begin, end = span(f, r["start"], r["stop"], r["size"], r["codec"])
                        f.seek(begin := max(begin, r["mark"]))
                        yield (*(r[c] for c in ("path", "i", "start", "stop", "size", "mark", "codec", "delimiter")), list(Quoting(r["delimiter"]).map(decoded(f.read(max(0, end - begin)), r["codec"]))))

        yield from batches_of(rows(), ["path", "i", "start", "stop", "size", "mark", "codec", "delimiter", "map"], [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.int32())], 64)

    shape = "path string, i bigint, start bigint, stop bigint, size bigint, mark bigint, codec string, delimiter string"
    maps = write(parts.withColumn("i", F.col("i").cast("bigint")).join(facts, "path").mapInArrow(mapped, f"{shape}, map array<int>"))
    before = F.collect_list("map").over(Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    begun = maps.withColumn("state", F.aggregate(before, F.lit(BLANK), lambda s, m: F.get(m, s))).drop("map")

    def parsed(batches):
        def rows():
            for b in batches:
                for r in b.to_pylist():
                    with open(r["path"], "rb") as f:
                        for j, cells in enumerate(_rows(f, r)):
                            yield (r["path"], r["i"], j, cells)

        yield from batches_of(rows(), ["path", "i", "j", "cells"], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())], 1024)

    each = write(begun.repartition("path", "i").mapInArrow(parsed, "path string, i bigint, j bigint, cells array<string>"))
    n = each.groupBy("path", "i").agg(F.count("*").alias("n"))
    base = n.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return each.join(base, ["path", "i"]).select("path", (F.col("base") + F.col("j")).alias("row_no"), "cells")


def _rows(f, r: dict) -> Iterator[list[str]]:
    """The rows that belong to a range."""
    quoting, codec = Quoting(r["delimiter"]), r["codec"]
    begin, end = span(f, r["start"], r["stop"], r["size"], codec)
    f.seek(begin := max(begin, r["mark"]))
    text = decoded(f.read(max(0, end - begin)), codec)
    breaks = list(quoting.breaks(text, r["state"]))
    first = 0 if r["i"] == 0 else breaks[0] + 1 if breaks else None
    if first is None:
        return
    maps, state, more = quoting.map(text), None, []
    state, at = maps[r["state"]], end
    while at < r["size"]:  # the last row goes on to the next line break that ends one
        to = min(cut(f, at + AHEAD, codec), r["size"]) if at + AHEAD < r["size"] else r["size"]
        f.seek(at)
        data = decoded(f.read(to - at), codec)
        if (stop := next(quoting.breaks(data, state), None)) is not None:
            more.append(data[:stop])
            break
        more.append(data)
        state, at = quoting.map(data)[state], to
    yield from rows_of(text[first:] + "".join(more), r["delimiter"])
