"""Network captures as a Spark data source: spark.read.format("capture").load(path), one row per packet.

Both byte orders, micro- and nanosecond classic files and the block format. A damaged file gives the packets
before the damage and one row with the error; it never fails the job. Options: path (file or folder on a file
system that the executors see), or read_content() for files that Spark's binaryFile source has read.
"""

from __future__ import annotations

import glob
import io
import os
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.arrow import bounded

SCHEMA = "file string, seq bigint, at_ns bigint, link_type int, data binary, original_len bigint, truncated boolean, capped boolean, error string"
#: Packets of a file, bytes of a packet and of a block (fixed values).
MOST_PACKETS, MOST_BYTES, MOST_BLOCK = 5_000_000, 8 << 20, 16 << 20
_CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
_SECTION = b"\x0a\x0d\x0d\x0a"


def packets(name: str, f: BinaryIO, skip: Skip | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA; the last one alone says truncated, capped or error, and has no data if it is no packet."""
    state = {"truncated": False, "capped": False, "error": None}
    n, magic = 0, f.read(4)
    if magic in _CLASSIC:
        source = _classic(f, *_CLASSIC[magic], state, skip)
    elif magic == _SECTION:
        source = _blocks(f, state, skip)
    else:
        source = iter(())
        state["error"] = "not a capture"
    try:
        for at, link, data, length in source:
            yield (name, n, at, link, data, length, None, None, None)
            n += 1
            if n >= MOST_PACKETS:
                state["capped"] = True
                break
    except (struct.error, ValueError) as problem:
        state["error"] = str(problem)
    if not n and not state["error"]:
        state["error"] = "no packets"
    yield (name, None, None, None, None, None, state["truncated"], state["capped"], state["error"])


def _classic(f: BinaryIO, order: str, tick: int, state: dict, skip: Skip | None) -> Iterator[tuple]:
    head = f.read(20)
    if len(head) < 20:
        return
    yield from classic_records(f, order, tick, struct.unpack(f"{order}I", head[16:])[0] & 0xFFFF, state, 24, skip=skip)


def classic_records(f: BinaryIO, order: str, tick: int, link: int, state: dict, at: int, stop: float = float("inf"), skip: Skip | None = None) -> Iterator[tuple]:
    """The packets whose records begin from at, where f is, to before stop; state["at"] is where the next one begins.

    The data of a packet whose time skip takes is passed by: its length stands in its place.
    """
    state["at"] = at
    while state["at"] < stop and len(record := f.read(16)) == 16:
        seconds, ticks, kept, original = struct.unpack(f"{order}4I", record)
        if kept > MOST_BYTES:
            raise ValueError("damaged: a packet of impossible length")
        when = seconds * 1_000_000_000 + min(ticks * tick, 999_999_999)
        data = skip.past(f, kept) if skip and skip.takes(when) else f.read(kept)
        if data is None or not isinstance(data, int) and len(data) < kept:
            state["truncated"] = True
            return
        state["at"] += 16 + kept
        yield when, link, data, original


def _blocks(f: BinaryIO, state: dict, skip: Skip | None) -> Iterator[tuple]:
    start = f.read(8)
    if len(start) < 8:
        return
    order = "<" if start[4:] == b"\x4d\x3c\x2b\x1a" else ">"
    total = struct.unpack(f"{order}I", start[:4])[0]
    if total < 12 or total % 4 or total > MOST_BLOCK:
        raise ValueError("damaged: a block of impossible length")
    f.read(total - 12)
    yield from block_records(f, order, [], state, total, skip=skip)


def block_records(f: BinaryIO, order: str, links: list[tuple[int, int, bool]], state: dict, at: int, stop: float = float("inf"), skip: Skip | None = None) -> Iterator[tuple]:
    """The packets of the blocks that begin from at, where f is, to before stop.

    links: link type, resolution and unusable clock of the interfaces named so far; new ones are added. state["at"] is
    where the next block begins, state["ended"] whether another section does there. skip: as for classic records.
    """
    state["at"] = at
    while state["at"] < stop and len(head := f.read(8)) == 8:
        kind, total = struct.unpack(f"{order}II", head)
        if kind == 0x0A0D0D0A:
            state["ended"] = True
            return
        if total < 12 or total % 4 or total > MOST_BLOCK:
            raise ValueError("damaged: a block of impossible length")
        inner, passed = total - 12, False
        body = f.read(min(_FIXED.get(kind, total), total - 8) if skip else total - 8)
        if skip and kind in _FIXED and inner >= _FIXED[kind] and len(body) == _FIXED[kind]:
            passed = skip.takes(_time(body, order, links)[0] if kind == 6 else None)
            rest = skip.past(f, total - 8 - len(body)) if passed else f.read(total - 8 - len(body))
            if rest is None:
                state["truncated"] = True
                return
            body += b"" if passed else rest
        if not passed and len(body) < total - 8:
            state["truncated"] = True
            return
        body = body[:inner]
        state["at"] += total
        if kind == 1 and len(body) >= 8:
            links.append(_interface(body, order))
        elif kind == 6 and inner >= 20:
            kept, original = struct.unpack(f"{order}2I", body[12:20])
            if kept > inner - 20:
                state["truncated"] = True
                return
            when, link = _time(body, order, links)
            yield when, link, kept if passed else body[20 : 20 + kept], original
        elif kind == 3 and inner >= 4:
            link = links[0][0] if links else 1
            yield None, link, inner - 4 if passed else body[4:], struct.unpack(f"{order}I", body[:4])[0]


#: Bytes of a packet's block before its data, by kind (fixed values).
_FIXED = {6: 20, 3: 4}


def _time(body: bytes, order: str, links: list[tuple[int, int, bool]]) -> tuple[int | None, int]:
    """Time in ns, null if its interface has no usable clock, and link type of a packet's block."""
    which, high, low = struct.unpack(f"{order}3I", body[:12])
    link, resolution, off = links[which] if which < len(links) else (1, 6, False)
    at = None if off or resolution > 9 else (high << 32 | low) * 10 ** (9 - resolution)
    return at if at is None or at < 1 << 63 else None, link


class Skip:
    """Which packets' data isn't wanted, by their time, and how it is passed by in a file of size bytes."""

    def __init__(self, takes: Callable[[int | None], bool], size: int):
        self.takes, self.size = takes, size

    def past(self, f: BinaryIO, n: int) -> int | None:
        """n, if so many bytes were there to pass by."""
        return n if f.seek(n, 1) <= self.size else None


def _interface(body: bytes, order: str) -> tuple[int, int, bool]:
    link, at, resolution, off = struct.unpack(f"{order}H", body[:2])[0], 8, 6, False
    while at + 4 <= len(body):
        code, size = struct.unpack(f"{order}HH", body[at : at + 4])
        if code == 0:
            break
        if code == 9 and size >= 1 and at + 4 < len(body):
            off, resolution = bool(body[at + 4] & 0x80) or (body[at + 4] & 0x7F) > 9, body[at + 4] & 0x7F
        at += 4 + -(-size // 4) * 4
    return link, resolution, off


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        found = sorted(p for p in glob.glob(os.path.join(self.path, "**"), recursive=True) if os.path.isfile(p)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_File(p) for p in found]

    def read(self, partition):
        with open(partition.path, "rb", buffering=1 << 16) as f:
            yield from packets(partition.path, f)


class CaptureSource(DataSource):
    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_content(files: DataFrame) -> DataFrame:
    """The same rows from (path, content) of the binaryFile source, for stores that only Spark reads."""

    def rows(batches):
        import pyarrow as pa

        from ..functions.arrow import batches_of

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):  # one file's bytes at a time
                yield from batches_of(packets(name, io.BytesIO(content.as_py() or b"")), _names(), [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()])

    return bounded(files.select(F.col("path"), F.col("content"))).mapInArrow(rows, SCHEMA)


def _names() -> list[str]:
    return [c.split()[0] for c in SCHEMA.split(", ")]


def write_classic(rows: list[tuple[int, bytes]], link: int = 1, order: str = "<", nano: bool = False) -> bytes:
    """A classic file of (time in ns, data), for fixtures and round trips."""
    out = [struct.pack(f"{order}IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)]
    for at, data in rows:
        out.append(struct.pack(f"{order}4I", at // 10**9, at % 10**9 // (1 if nano else 1000), len(data), len(data)) + data)
    return b"".join(out)


def write_blocks(rows: list[tuple[int, bytes]], link: int = 1, order: str = "<") -> bytes:
    """A file of the block format with nanosecond times, an unknown block in it and the data padded to four bytes."""

    def block(kind: int, body: bytes) -> bytes:
        size = 12 + len(body)
        return struct.pack(f"{order}II", kind, size) + body + struct.pack(f"{order}I", size)

    face = struct.pack(f"{order}HHIHHB3xHH", link, 0, 0, 9, 1, 9, 0, 0)
    out = [block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1)), block(1, face), block(99, b"skip")]
    for at, data in rows:
        out.append(block(6, struct.pack(f"{order}IIIII", 0, at >> 32, at & 0xFFFFFFFF, len(data), len(data)) + data + bytes(-len(data) % 4)))
    return b"".join(out)
