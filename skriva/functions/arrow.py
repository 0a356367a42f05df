"""Rows to Arrow batches."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes in a batch for Python, if the session doesn't say otherwise: ten thousand files may be any size.
BATCH, _BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def batches_of(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)


def bounded(rows: DataFrame) -> DataFrame:
    """The same rows, whose batches for Python are bounded by bytes."""
    conf = rows.sparkSession.conf
    if conf.get(_BYTES, None) in (None, "2147483647", "2147483647b"):
        conf.set(_BYTES, str(BATCH))
    return rows


def spread(rows: DataFrame, by: str) -> DataFrame:
    """Rows that take long each, over all partitions of a shuffle: a small file's are one task where it is read. Batches are bounded by bytes."""
    return bounded(rows).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
