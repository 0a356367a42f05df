"""Large captures read in byte ranges, with the rows and numbers that one reader from the start would give.

A range doesn't know where its first record begins, nor what number it has. So the ranges are walked first: each looks for
a run of plausible record heads (resynchronisation) and follows the records to the first one beyond its end. The first
range of a file begins behind the file's head, which is certain; a range is certain if the one before it is and ends
where this one has begun. Those that aren't are walked again from the end of the one before, in rounds, until all
are; so a payload that looks like records costs a walk, not a wrong row. Then counts of packets, summed in order,
number each range's first packet, and interfaces named in earlier ranges are handed on to the later ones.

What the sequential reader says in its last row (damage, a cut end, the limit of packets) is said in one row for a file.
Files are opened by the executors, by a path they all see; for stores that only Spark reads there is read_content().
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrow import batches_of
from . import capture

#: Bytes of a range; record heads in a row that make a beginning plausible; bytes that are searched at once.
RANGE, RUN, LOOK = 64 << 20, 4, 1 << 18
#: How far a plausible packet's clock may be from that of the file's first packet, in seconds.
YEARS = 10 * 366 * 86_400
_WALK = "path string, i bigint, start bigint, stop bigint, size bigint, first bigint, end bigint, n bigint, links array<struct<link:int,resolution:int,off:boolean>>, truncated boolean, ended boolean, error string"
_FACE = pa.struct([("link", pa.int32()), ("resolution", pa.int32()), ("off", pa.bool_())])
_WALK_KINDS = [pa.string(), *[pa.int64()] * 7, pa.list_(_FACE), pa.bool_(), pa.bool_(), pa.string()]
_NAMES = [c.split()[0] for c in "path i start stop size first end n links truncated ended error".split()]


class Opening:
    """What a file's head says: its form, byte order and where records begin. error: why there are none."""

    def __init__(self, f: BinaryIO):
        self.error, self.first, self.link, self.tick, self.clock = None, 0, 0, 0, None
        magic = f.read(4)
        self.blocks = magic == capture._SECTION
        if magic in capture._CLASSIC:
            self.order, self.tick = capture._CLASSIC[magic]
            head = f.read(20)
            self.first = 24 if len(head) == 20 else 4 + len(head)
            if len(head) == 20:
                self.link = struct.unpack(f"{self.order}I", head[16:])[0] & 0xFFFF
                if len(clock := f.read(4)) == 4:
                    self.clock = struct.unpack(f"{self.order}I", clock)[0]
        elif self.blocks:
            head = f.read(8)
            if len(head) == 8:
                self.order = "<" if head[4:] == b"\x4d\x3c\x2b\x1a" else ">"
                self.first = struct.unpack(f"{self.order}I", head[:4])[0]
                if self.first < 12 or self.first % 4 or self.first > capture.MOST_BLOCK:
                    self.error = "damaged: a block of impossible length"
            else:
                self.first, self.order = 4 + len(head), "<"
        else:
            self.error = "not a capture"

    def records(self, f: BinaryIO, at: int, stop: float, links: list, state: dict) -> Iterator[tuple]:
        f.seek(at)
        if self.blocks:
            return capture.block_records(f, self.order, links, state, at, stop)
        return capture.classic_records(f, self.order, self.tick, self.link, state, at, stop)


def plausible(f: BinaryIO, opening: Opening, start: int, stop: int, size: int) -> int | None:
    """Where a run of record heads begins, from start to before stop; a run may also end at the file's end."""
    for at in range(start, stop, LOOK):
        f.seek(at)
        data = np.frombuffer(f.read(LOOK + 16), np.uint8)
        n = min(len(data) - 15, stop - at)
        if n <= 0:
            return None
        word = lambda k, data=data, n=n: sum(data[k + j : k + j + n].astype(np.int64) << (8 * j if opening.order == "<" else 24 - 8 * j) for j in range(4))
        if opening.blocks:
            good = ((at + np.arange(n)) % 4 == opening.first % 4) & (word(4) >= 12) & (word(4) % 4 == 0) & (word(4) <= capture.MOST_BLOCK) & (word(0) <= 0xFFFF)
        else:
            kept, original = word(8), word(12)
            good = (word(4) * opening.tick < 1_000_000_000) & (kept <= capture.MOST_BYTES) & (kept <= original) & (original <= 1 << 24)
            if opening.clock is not None:
                good &= abs(word(0) - opening.clock) <= YEARS
        for i in np.flatnonzero(good).tolist():
            if _run(f, opening, at + i, size):
                return at + i
    return None


def _run(f: BinaryIO, opening: Opening, at: int, size: int) -> bool:
    for _ in range(RUN):
        if at == size:
            return True
        f.seek(at)
        head = f.read(16)
        if len(head) < 16 and not (opening.blocks and len(head) >= 12):
            return False
        if opening.blocks:
            kind, total = struct.unpack(f"{opening.order}II", head[:8])
            if total < 12 or total % 4 or total > capture.MOST_BLOCK or kind > 0xFFFF or at + total > size:
                return False
            f.seek(at + total - 4)
            if struct.unpack(f"{opening.order}I", f.read(4))[0] != total:
                return False
            at += total
        else:
            seconds, ticks, kept, original = struct.unpack(f"{opening.order}4I", head)
            if ticks * opening.tick >= 1_000_000_000 or kept > min(capture.MOST_BYTES, original) or opening.clock is not None and abs(seconds - opening.clock) > YEARS:
                return False
            at += 16 + kept
    return at <= size


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges with first, end, n, the interfaces they name and how they end. A first that is given is where the walk begins."""

    def rows():
        for b in batches:
            for r in b.to_pylist():
                with open(r["path"], "rb", buffering=1 << 16) as f:
                    opening = Opening(f)
                    state: dict = {"truncated": False, "ended": False}
                    error, links, n, at = opening.error, [], 0, r["first"]
                    if not error and at is None:
                        at = opening.first if r["i"] == 0 else plausible(f, opening, r["start"], r["stop"], r["size"])
                    state["at"] = at
                    if not error and at is not None:
                        try:
                            for _ in opening.records(f, at, r["stop"], links, state):
                                n += 1
                        except (struct.error, ValueError) as problem:
                            error = str(problem)
                yield (*(r[c] for c in ("path", "i", "start", "stop", "size")), at, state["at"], n, [dict(zip(("link", "resolution", "off"), x, strict=True)) for x in links], state["truncated"], state["ended"], error)

    yield from batches_of(rows(), _NAMES, _WALK_KINDS, 64)


def tasks(spark: SparkSession, sizes: list[int], size: int) -> int:
    """How many tasks walk files of these sizes by ranges of so many bytes: as many as a shuffle has, more only for ranges that take long together."""
    all_ = sum(-(-n // size) for n in sizes)
    return max(1, min(all_, 10_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(sizes) // RANGE)))


def ranges(spark: SparkSession, path: str, size: int = RANGE, write=None) -> DataFrame:
    """The certain ranges of all files at path, with base (the number of the first packet) and known (earlier interfaces).

    write: makes a table of rows that lasts; by default a checkpoint.
    """
    write = write or (lambda df: df.checkpoint())
    found = sorted(p for p in glob.glob(os.path.join(path, "**"), recursive=True) if os.path.isfile(p)) if os.path.isdir(path) else sorted(glob.glob(path))
    files = spark.createDataFrame([(p, os.path.getsize(p)) for p in found], "path string, size bigint")
    cut = files.select("path", "size", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("bigint"))).alias("i", "start"))
    cut = cut.select("path", F.col("i").cast("bigint").alias("i"), "start", F.least(F.col("start") + size, F.greatest("size", F.lit(1))).alias("stop"), "size", F.lit(None).cast("bigint").alias("first"))
    walked = write(cut.repartition(tasks(spark, [os.path.getsize(p) for p in found], size), "path", "i").mapInArrow(_walked, _WALK))
    by_file = Window.partitionBy("path").orderBy("i")
    while True:
        # what is before a range that fails ends the file for the sequential reader, so nothing behind it has to be certain
        over = F.col("error").isNotNull() | F.col("truncated") | F.col("ended")
        before = F.coalesce(F.max(over).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        chained = walked.withColumn("begins", F.lag("end").over(by_file)).withColumn("over", before)
        wrong = write(chained.filter((F.col("i") > 0) & ~F.col("over") & ~F.col("begins").eqNullSafe(F.col("first"))))
        if wrong.isEmpty():
            break
        again = wrong.select("path", "i", "start", "stop", "size", F.col("begins").alias("first")).repartition("path", "i").mapInArrow(_walked, _WALK)
        walked = write(walked.join(wrong.select("path", "i"), ["path", "i"], "left_anti").unionByName(again))
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    certain = chained.filter(~F.col("over"))
    return certain.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("known", F.flatten(F.collect_list("links").over(earlier))).drop("begins", "over")


def read_ranges(spark: SparkSession, path: str, size: int = RANGE, write=None, most: int = capture.MOST_PACKETS) -> DataFrame:
    """capture.SCHEMA of all files at path, read by ranges of size bytes; of a file at most so many packets."""
    found = ranges(spark, path, size, write)

    def rows(batches):
        def packets():
            for b in batches:
                for r in b.to_pylist():
                    if r["first"] is None or not r["n"]:
                        continue
                    with open(r["path"], "rb", buffering=1 << 16) as f:
                        opening = Opening(f)
                        links = [(x["link"], x["resolution"], x["off"]) for x in r["known"]]
                        source = opening.records(f, r["first"], r["stop"], links, {"truncated": False})
                        for j in range(min(r["n"], most - r["base"])):  # so damage behind the last packet isn't met
                            at, link, data, length = next(source)
                            yield (r["path"], r["base"] + j, at, link, data, length, None, None, None)

        yield from batches_of(packets(), capture._names(), [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()], 1024)

    each = found.select("path", "i", "first", "stop", "n", "base", "known").repartition("path", "i").mapInArrow(rows, capture.SCHEMA)
    total = F.sum("n")
    full = total >= most
    last = found.groupBy("path").agg(F.bool_or("truncated").alias("truncated"), full.alias("capped"), F.max("error").alias("error"), total.alias("n"))
    said = F.when(F.col("capped"), None).otherwise(F.coalesce("error", F.when(F.col("n") == 0, F.lit("no packets"))))
    nothing = lambda kind: F.lit(None).cast(kind)
    end = last.select(F.col("path").alias("file"), nothing("bigint").alias("seq"), nothing("bigint").alias("at_ns"), nothing("int").alias("link_type"), nothing("binary").alias("data"), nothing("bigint").alias("original_len"), (F.col("truncated") & ~F.col("capped")).alias("truncated"), "capped", said.alias("error"))
    return each.unionByName(end)
