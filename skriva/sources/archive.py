"""Archives of tracks: entries from the headers alone, and manifests as XML or lines; archives written as their rows come.

An archive's list is walked record by record and written from a file of its own, so neither reading nor writing holds
more than a few of its entries, however many there are.
"""

from __future__ import annotations

import re
import shutil
import struct
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import BinaryIO
from xml.etree import ElementTree
from zipfile import BadZipFile

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.arrow import batches_of, spread

#: Bytes of a manifest and its entries (fixed values).
MOST_MANIFEST, MOST_ENTRIES = 1 << 20, 500
#: Bytes of an archive's list that are read at once, and bytes from which a member is compressed.
AT_ONCE, SMALL = 1 << 20, 64
_RECORD, _END, _WIDE_END = struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH"), struct.Struct("<4sQ2H2I4Q")
_NONE, _FEW = 0xFFFFFFFF, 0xFFFF


def _list_of(f: BinaryIO) -> tuple[int, int]:
    """Where the list of entries begins, and its bytes."""
    size = f.seek(0, 2)
    begin = max(0, size - _END.size - _FEW)
    f.seek(begin)
    tail = f.read(size - begin)
    at = len(tail) - _END.size
    if at < 0 or tail[at : at + 4] != b"PK\5\6" or tail[-2:] != b"\0\0":
        at = tail.rfind(b"PK\5\6")
    if at < 0 or len(tail) - at < _END.size:
        raise BadZipFile("File is not a zip file")
    length, offset = _END.unpack_from(tail, at)[5:7]
    end = begin + at
    f.seek(max(0, end - 20 - _WIDE_END.size))
    before = f.read(min(end, 20 + _WIDE_END.size))
    if len(before) == 20 + _WIDE_END.size and before[-20:-16] == b"PK\6\7" and before[:4] == b"PK\6\6":
        length, offset = _WIDE_END.unpack_from(before)[8:10]
        end -= len(before)
    if end - length < 0:
        raise BadZipFile("Bad offset for central directory")
    return end - length, length  # what stands before the archive moves all offsets


def _named(raw: bytes, flags: int, extra: bytes, size: int) -> tuple[str, int]:
    """An entry's name and size, which its extra fields may tell anew."""
    name = raw.decode("utf-8" if flags & 0x800 else "cp437")
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<2H", extra)
        if n + 4 > len(extra):
            raise BadZipFile(f"Corrupt extra field {kind:04x} (size={n})")
        if kind == 1 and size in (_NONE, 0xFFFFFFFFFFFFFFFF):
            if n < 8:
                raise BadZipFile("Corrupt zip64 extra field. File size not found.")
            size = struct.unpack_from("<Q", extra, 4)[0]
        if kind == 0x7075 and n > 5 and extra[4] == 1 and struct.unpack_from("<I", extra, 5)[0] == zlib.crc32(raw):
            name = extra[9 : 4 + n].decode()
        extra = extra[4 + n :]
    return name.partition("\0")[0], size


def listed(f: BinaryIO) -> Iterator[tuple[str, int]]:
    """(name, size) of all entries in the order of the archive's list, read piece by piece; f can be sought in."""
    begin, left = _list_of(f)
    f.seek(begin)
    held, at = b"", 0
    while left > 0 or at < len(held):
        if left > 0 and len(held) - at < _RECORD.size + 3 * _FEW:
            more = f.read(min(left, AT_ONCE))
            left = left - len(more) if more else 0
            held, at = held[at:] + more, 0
        if len(held) - at < _RECORD.size:
            raise BadZipFile("Truncated central directory")
        magic, _, _, flags, _, _, _, _, _, size, n, m, k, *_ = _RECORD.unpack_from(held, at)
        if magic != b"PK\1\2":
            raise BadZipFile("Bad magic number for central directory")
        at += _RECORD.size
        yield _named(held[at : at + n], flags, held[at + n : at + n + m], size)
        at += n + m + k


def read_entries(files: DataFrame) -> DataFrame:
    """archive, entry_index, path, size, error; nothing is inflated. files: path and content, or path and file, a place that executors can open."""

    def opened(b):
        if "content" in b.schema.names:
            yield from (pa.BufferReader(c.as_buffer() if c.is_valid else pa.py_buffer(b"")) for c in b.column(1))
        else:
            yield from (open(name, "rb") for name in b.column(1).to_pylist())

    def rows(batches):
        names, kinds = ["archive", "entry_index", "path", "size", "error"], [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            for path, f in zip(b.column(0).to_pylist(), opened(b), strict=True):
                with f:
                    try:
                        for _ in listed(f):  # an archive with a fault has no entries
                            pass
                    except (BadZipFile, ValueError, OSError) as problem:
                        yield from batches_of([(path, None, None, None, str(problem))], names, kinds)
                    else:
                        yield from batches_of(((path, i, *e, None) for i, e in enumerate(listed(f))), names, kinds)

    place = "content" if "content" in files.columns else "file"
    return files.select("path", place).mapInArrow(rows, "archive string, entry_index int, path string, size bigint, error string")


class Writer:
    """An archive file that gets its members one by one; its list waits in a temporary file."""

    def __init__(self, path: str):
        self.file, self.list, self.size, self.count = open(path, "wb"), tempfile.TemporaryFile(), 0, 0  # noqa: SIM115

    def add(self, name: str, data: bytes) -> None:
        if len(data) >= _NONE:
            raise ValueError(f"{name} has {len(data)} bytes")
        raw, packed = name.encode(), zlib.compress(data, wbits=-15) if len(data) >= SMALL else data
        packed = packed if len(packed) < len(data) else data
        about = struct.pack("<5H3I2H", 20, 0 if raw.isascii() else 0x800, 8 if len(packed) < len(data) else 0, 0, 33, zlib.crc32(data), len(packed), len(data), len(raw), 0)
        far = struct.pack("<2HQ", 1, 8, self.size) if self.size >= _NONE else b""
        self.file.write(b"".join((b"PK\3\4", about, raw, packed)))
        self.list.write(b"".join((b"PK\1\2\x2d\3", about[:-2], struct.pack("<4H2I", len(far), 0, 0, 0, 0o600 << 16, min(self.size, _NONE)), raw, far)))
        self.size += 30 + len(raw) + len(packed)
        self.count += 1

    def close(self) -> None:
        length = self.list.tell()
        self.list.seek(0)
        shutil.copyfileobj(self.list, self.file)
        if self.count >= _FEW or max(self.size, length) >= _NONE:
            end = self.size + length
            self.file.write(_WIDE_END.pack(b"PK\6\6", 44, 45, 45, 0, 0, self.count, self.count, length, self.size) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self.file.write(_END.pack(b"PK\5\6", 0, 0, min(self.count, _FEW), min(self.count, _FEW), min(length, _NONE), min(self.size, _NONE), 0))
        self.file.close()
        self.list.close()


def write_archives(rows: DataFrame, order: list[str], members: Callable[[dict], Iterable[tuple[str, bytes]]], folder: str) -> DataFrame:
    """path and file: an archive in the folder, which executors share, for each path; members() gives the members of a row, in this order of rows."""

    def store(batches):
        path = file = out = None
        for b in batches:
            for r in b.to_pylist():
                if out is None or r["path"] != path:
                    if out is not None:
                        out.close()
                        yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([file])], ["path", "file"])
                    Path(folder).mkdir(parents=True, exist_ok=True)
                    path, file = r["path"], f"{folder}/{uuid.uuid4().hex}"  # another one where a task runs again
                    out = Writer(file)
                for name, data in members(r):
                    out.add(name, data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([file])], ["path", "file"])

    return spread(rows, "path").sortWithinPartitions("path", *order).mapInArrow(store, "path string, file string")


def manifest(text: str) -> Iterator[tuple[str, str | None, int | None]]:
    """(name, kind, position): audio elements, or else lines that aren't blank or comments."""
    found = []
    if "<" in text:
        try:
            if "<!DOCTYPE" not in text and "<!ENTITY" not in text:
                found = [("".join(e.itertext()).strip(), e.get("type"), e.get("pos")) for e in ElementTree.fromstring(text.encode()).iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "audio"]
        except ElementTree.ParseError:
            found = [(m[2].strip(), *[(k := re.search(rf'{a}\s*=\s*"([^"]*)"', m[1])) and k[1] for a in ("type", "pos")]) for m in re.finditer(r"<audio\b([^>]*)>([^<]*)", text)]
    else:
        found = [(x.strip(), None, None) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    for name, kind, pos in [f for f in found if f[0]][:MOST_ENTRIES]:
        yield name, kind, int(pos) if pos and re.fullmatch(r"\s*\d+\s*", pos) else None


def read_manifests(files: DataFrame) -> DataFrame:
    """archive, line, name, kind, pos from (path, text)."""

    def rows(batches):
        for b in batches:
            out = [(path, i, *e) for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, e in enumerate(manifest((text or "")[:MOST_MANIFEST]))]
            yield from batches_of(out, ["archive", "line", "name", "kind", "pos"], [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()])

    return files.select("path", "text").mapInArrow(rows, "archive string, line int, name string, kind string, pos bigint")
