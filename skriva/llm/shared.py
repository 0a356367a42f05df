"""What the operators share: the shared scratch folder and vectorised text hashing over Arrow buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are hashed at once; a longer document is a piece of its own.
PIECE = 1 << 19
#: Bytes that Spark puts in a batch for Python, if the session doesn't say otherwise: ten thousand rows may be any size.
BATCH, _BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a checkpoint that a task reads.
READ = 4 << 20
#: ASCII white space, the word separator of most contracts.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_BYTE = np.random.default_rng(20_240_611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share. Where none is named, a local run has one of its own; a cluster must name it."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="skriva-")
        spark.sparkContext.setCheckpointDir(top)
        top = spark.sparkContext.getCheckpointDir()
    _MADE.append(path := f"{top.rstrip('/')}/skriva-{uuid.uuid4().hex}")
    return path


def sweep(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes tables of the shared folder: these, or all that this driver has written and still has there."""
    here = set(_MADE)
    for name in list(_MADE if paths is None else paths):
        if name in here:
            here.discard(name)
            _MADE.remove(name)
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reads(df: DataFrame, path: str) -> bool:
    """Whether the plan of df reads this table."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return any(path in leaves.apply(i).toString() or "LogicalRelation" in leaves.apply(i).getClass().getName() and path in leaves.apply(i).relation().location().rootPaths().toString() for i in range(leaves.size()))


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage, so that Spark cleans up broadcasts, shuffles and checkpoints that nothing names any more."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The list gets the paths of the tables written meanwhile that are still there at the end."""
    before, out = set(_MADE), []
    yield out
    out.extend(p for p in _MADE if p not in before)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and a lost executor costs nothing that was done."""
    path = scratch(df.sparkSession)
    out = df.write.partitionBy(*by) if by else df.write
    out.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.__dict__["scratch"] = path
    return back


def kept(df: DataFrame) -> DataFrame:
    """A table of few short columns as a checkpoint, which also ends its lineage.

    A task of Spark's file writers unpacks the whole Hadoop configuration; between the many small steps of a
    graph or of a search in rounds that would be most of their work and of an executor's native memory. It is
    read in as many tasks as its bytes ask for, not as wrote it: the driver keeps an account of each task of each step.
    """
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(scratch(df.sparkSession))
    back = df.checkpoint()
    file = back._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _MADE.append(file.get())
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        size = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        back = back.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // READ)))
        back.__dict__["scratch"] = file.get()
    return back


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled for it, never broadcast.

    The joins of a graph are many and their sides are as long as the corpus: Spark broadcasts each of them that is below
    its threshold, through the driver and into its memory, where they stay until its garbage is collected.
    """
    return df.hint("merge")


def drop(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    sweep(df.sparkSession, [df.__dict__["scratch"]])


def arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of bounded size; at its end a task gives its memory back, as idle workers stay beside the running ones."""
    conf = df.sparkSession.conf
    if conf.get(_BYTES, None) in (None, "2147483647", "2147483647b"):
        conf.set(_BYTES, str(BATCH))

    def task(batches):
        try:
            yield from rows(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def release() -> None:
    global _POWERS
    if len(_POWERS[0]) > PIECE + 1:
        _POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def fold_of(ids: pa.Array | list, k: int) -> np.ndarray:
    """crc32 of each id as text, mod k; a null id counts as the empty string."""
    ids = ids.to_pylist() if isinstance(ids, (pa.Array, pa.ChunkedArray)) else ids
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % k for i in ids), np.int64, len(ids))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): each batch cut into runs of whole rows of about so many bytes; null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def spans(buf: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts by row) of the words: the longest runs without a byte of breaks."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    ok = ~breaks[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = ok.copy()
    first[1:] &= ~ok[:-1] | edge[1:-1]
    last = ok.copy()
    last[:-1] &= ~ok[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, off))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) <= n:
        size = max(n + 1, PIECE + 1)
        one = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 2**64), np.uint64)
        for x in one:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        if n > 4 * PIECE:
            return one
        _POWERS = one
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = _SAME) -> np.ndarray:
    """64-bit hash of every span, equal for equal bytes after the letter map."""
    power, back = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[letters][buf] * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts])


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and their count by row; a row of fewer words, but not none, gives one of all its words."""
    end = np.cumsum(counts)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if not len(words):
        return np.zeros(0, np.uint64), made
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    at = np.arange(len(words))
    left = np.repeat(end, counts) - at
    out = np.zeros(len(words), np.uint64)
    for j in range(k):
        w = padded[j : j + len(words)]
        out = np.where(left > j, out * np.uint64(0x9FB21C651E98DF25) + w, out)
    keep = (left >= k) | (np.repeat(counts, counts) == left)
    keep &= (at - np.repeat(end - counts, counts)) < np.repeat(made, counts)
    return mix(out[keep]), made


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype if values.dtype.kind in "fu" else np.int64), np.cumsum(values, 0)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def as_batch(names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def chunked(items: Iterator, n: int) -> Iterator[list]:
    items = iter(items)
    while some := list(itertools.islice(items, n)):
        yield some
