"""Growing captures as a stream: spark.readStream.format("capture_stream").load(path), each packet once, with its number.

An offset holds for each file where its next record begins, how many packets are before that and the interfaces named so
far. The driver steps from record head to record head over what is new (once over everything after a restart), without
reading packets; a record that is cut at the file's end waits. The executors read what lies between two offsets, a task
for each rangeBytes. Options: path (file or folder that driver and executors see), rangeBytes.

Rows are those of capture.SCHEMA. A file that is damaged, no capture or at the limit of packets says so in one row and ends
there; another section ends a file too. Fewer than 24 bytes wait for more. In a folder, names that begin with . or _ or end
in .part are files that someone still writes, and are left. Files only grow: one that is written anew, or goes, gives nothing more.
"""

from __future__ import annotations

import os
import struct

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import capture
from .capture_ranges import RANGE, Opening

#: Where a file stands at first: byte, packets before it, interfaces, whether it has ended, why.
_FRESH = [0, 0, [], False, None]


def advance(path: str, was: list, stop: int | None = None, most: int = capture.MOST_PACKETS) -> list:
    """Where the next record begins after stepping over all whole ones, or over those that begin before stop."""
    at, n, links, over, error = was[0], was[1], [tuple(x) for x in was[2]], was[3], was[4]
    if over:
        return was
    with open(path, "rb", buffering=0) as f:
        size = os.fstat(f.fileno()).st_size
        if size < 24:
            return was
        opening = Opening(f)
        if opening.error:
            return [0, 0, [], True, opening.error]
        at = at or opening.first
        while at < (size if stop is None else stop) and not over:
            f.seek(at)
            head = f.read(28)
            if len(head) < (8 if opening.blocks else 16):
                break
            if opening.blocks:
                kind, total = struct.unpack(f"{opening.order}II", head[:8])
                if kind == 0x0A0D0D0A:
                    over = True
                    break
                if total < 12 or total % 4 or total > capture.MOST_BLOCK:
                    over, error = True, "damaged: a block of impossible length"
                    break
                if at + total > size:
                    break
                packet = kind == 6 and total >= 32 or kind == 3 and total >= 16
                if kind == 6 and packet and struct.unpack(f"{opening.order}I", head[20:24])[0] > total - 32:
                    over, error = True, "damaged: a packet longer than its block"
                    break
                if kind == 1 and total >= 20:
                    f.seek(at + 8)
                    links.append(capture._interface(f.read(total - 12), opening.order))
            else:
                kept = struct.unpack(f"{opening.order}I", head[8:12])[0]
                if kept > capture.MOST_BYTES:
                    over, error = True, "damaged: a packet of impossible length"
                    break
                total, packet = 16 + kept, True
                if at + total > size:
                    break
            at, n = at + total, n + packet
            over = n >= most
    return [at, n, [list(x) for x in links], over, error]


class _Piece(InputPartition):
    def __init__(self, path: str, start: list, stop: int, last: bool, end: list):
        self.path, self.start, self.stop, self.last, self.end = path, start, stop, last, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangeBytes", RANGE))
        self.now: dict[str, list] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        folder = os.path.isdir(self.path)
        found = sorted(os.path.join(d, name) for d, _, names in os.walk(self.path) for name in names if name[0] not in "._" and not name.endswith(".part")) if folder else [self.path]
        for p in found:
            if os.path.isfile(p):
                at = advance(p, self.now.get(p, _FRESH))
                if at != _FRESH:
                    self.now[p] = at
        return dict(self.now)

    def partitions(self, start, end):
        out = []
        for path, stop in sorted(end.items()):
            at = start.get(path, _FRESH)
            if at == stop:
                continue
            while at[0] < stop[0]:
                after = advance(path, at, min((at[0] or 0) + self.range, stop[0]))
                after = stop if after[0] >= stop[0] else after
                out.append(_Piece(path, at, after[0], after is stop, stop))
                at = after
            if at is not stop:
                out.append(_Piece(path, at, stop[0], True, stop))
        return out

    def read(self, partition):
        at, n, links = partition.start[:3]
        with open(partition.path, "rb", buffering=1 << 16) as f:
            opening = Opening(f)
            if not opening.error and (at or opening.first) < partition.stop:
                for when, link, data, length in opening.records(f, at or opening.first, partition.stop, [tuple(x) for x in links], {"truncated": False}):
                    yield (partition.path, n, when, link, data, length, None, None, None)
                    n += 1
        if partition.last and partition.end[3]:
            yield (partition.path, None, None, None, None, None, False, partition.end[1] >= capture.MOST_PACKETS, partition.end[4])


class CaptureStream(DataSource):
    @classmethod
    def name(cls):
        return "capture_stream"

    def schema(self):
        return capture.SCHEMA

    def streamReader(self, schema):
        return _Reader(self.options)
