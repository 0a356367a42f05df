"""Captures read no further than is asked for: spark.read.format("capture_scan").

Columns are those of the schema that the reader is given, of SCHEMA and captured_len. Without data among them, packets'
bytes are neither read nor shipped. Options from and to, in ns, bound the times: the data of packets outside is passed by
and no row of theirs is made, nor of how a file ended. packetsOnly leaves out only the latter.

The bounds are options and not pushed filters on purpose: Spark 4.1 keeps what it has pushed to a Python source with the
loaded table, so a second plan over the same DataFrame, without the filter, would get the first one's rows.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from ..functions.arrow import batches_of
from . import capture

SCHEMA = capture.SCHEMA + ", captured_len bigint"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


class _Reader(capture._Reader):
    def __init__(self, options: dict, names: list[str]):
        super().__init__(options)
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        if unknown := set(names) - set(kinds):
            raise ValueError(f"no columns of a capture: {sorted(unknown)}")
        self.names, self.kinds = names, [_KINDS[kinds[n]] for n in names]
        self.at = [list(kinds).index(n) for n in names]
        self.low, self.high = (int(options[k]) if options.get(k) is not None else None for k in ("from", "to"))
        self.bounded = self.low is not None or self.high is not None
        self.packets_only = self.bounded or options.get("packetsOnly", "false").lower() == "true"

    def _within(self, at: int | None) -> bool:
        return not self.bounded or at is not None and (self.low is None or at >= self.low) and (self.high is None or at <= self.high)

    def rows(self, path: str, f, size: int):
        """The rows of SCHEMA that are asked for."""
        takes = (lambda at: not self._within(at)) if "data" in self.names else (lambda at: True)
        for r in capture.packets(path, f, capture.Skip(takes, size)):
            if r[1] is None and self.packets_only or r[1] is not None and not self._within(r[2]):
                continue
            length = r[4] if r[4] is None or isinstance(r[4], int) else len(r[4])
            yield (*r[:4], None if isinstance(r[4], int) else r[4], *r[5:], length)

    def read(self, partition):
        with open(partition.path, "rb", buffering=1 << 13) as f:
            size = os.fstat(f.fileno()).st_size
            if self.names:
                yield from batches_of((tuple(r[i] for i in self.at) for r in self.rows(partition.path, f, size)), self.names, self.kinds)


class CaptureScan(DataSource):
    @classmethod
    def name(cls):
        return "capture_scan"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options, [f.name for f in schema.fields])


def scan(spark: SparkSession, path: str, *columns: str, low: int | None = None, high: int | None = None, packets_only: bool = False) -> DataFrame:
    """The captures under path with these columns alone, all if none are named, of packets from low to high."""
    spark.dataSource.register(CaptureScan)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    options = {"from": low, "to": high, "packetsOnly": packets_only}
    return spark.read.format("capture_scan").schema(", ".join(f"{n} {kinds[n]}" for n in columns or kinds)).options(**{k: v for k, v in options.items() if v is not None}).load(path)
