"""Rows as files that anyone can open: a sink whose runs appear whole or not at all.

df.write.format("named_files").mode("append").option("path", ...).option("run", ...).save() takes (name, content).
A task writes into a folder of its attempt; what it commits is that folder's name. The job's commit gathers the
folders of the attempts that count, a rename each, and one more rename shows the run. An attempt that died, or ran
beside another, leaves its folder behind, which goes with the rest of the pending ones. So the driver handles tasks,
not files. A run that is there is complete, and writing it again changes nothing.

The path has to be a folder that the driver and all executors see, on a file system whose renames are atomic.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.arrow import BATCH, bounded, spread
from .files import write_wav

#: Files in a batch that is read back.
FILES = 4096


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its folder among the pending ones, None if it had no row."""

    partition: int
    folder: str | None
    files: int


def _checked(name: str | None) -> str:
    if not name or name in (".", "..") or "/" in name or "\0" in name or name.startswith(("_", ".")):
        raise ValueError(f"not the name of a file: {name!r}")
    return name


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.shown = os.path.join(path, f"run={_checked(run)}")
        self.pending = os.path.join(path, "_pending", f"{run}-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        folder, n = os.path.join(self.pending, f"{context.partitionId():06d}-{context.taskAttemptId()}"), 0
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if not n:
                    os.makedirs(folder)
                # x: a name that the task has written already is an error, as one file would hide the other
                with open(os.path.join(folder, _checked(name)), "xb") as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                n += 1
        return Part(context.partitionId(), folder if n else None, n)

    def commit(self, messages: list[Part | None]) -> None:
        ready = os.path.join(self.pending, "ready")
        os.makedirs(ready)
        for m in messages:
            if m is not None and m.folder:
                os.rename(m.folder, os.path.join(ready, f"part-{m.partition:06d}"))
        if not os.path.isdir(self.shown):
            try:
                os.rename(ready, self.shown)
            except OSError:
                # another writer of the same run was first
                if not os.path.isdir(self.shown):
                    raise
        self._sweep()

    def abort(self, messages: list[Part | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class NamedFiles(DataSource):
    @classmethod
    def name(cls):
        return "named_files"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("runs are added; none is overwritten")
        return _Writer(self.options["path"], self.options["run"])


def write_files(df: DataFrame, path: str, run: str) -> None:
    """The rows (name, content) as files path/run=<run>/part-*/<name>, each name once.

    Content is binary or a string, which is written as UTF-8; a null is an empty file. Rows are dealt by name, so two of one
    name meet in a task, and the write fails without a trace; jobs.unique_names gives names that differ. A name that is null
    or leads elsewhere fails too. No rows: an empty run. Other columns aren't read.
    """
    df.sparkSession.dataSource.register(NamedFiles)
    rows = spread(df.select("name", F.col("content").cast("binary").alias("content")), "name")
    rows.write.format("named_files").mode("append").option("path", path).option("run", run).save()


def read_files(spark: SparkSession, path: str, run: str) -> DataFrame:
    """name and content of the files of a run; empty files are passed by.

    A task reads what a task of the writer wrote. Listed by Spark, all names would go through the driver, and a task get
    some thirty files, as a file counts as 4 MB there.
    """
    shown = os.path.join(path, f"run={_checked(run)}")
    parts = sorted(os.listdir(shown))

    def rows(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from _batches(os.path.join(shown, parts[i]))

    each = spark.range(0, len(parts), 1, max(len(parts), 1))
    return bounded(each).mapInArrow(rows, "name string, content binary")


def _batches(folder: str) -> Iterator[pa.RecordBatch]:
    """name and content of a folder's files that aren't empty, in batches bounded by files and by bytes."""
    names: list[str] = []
    contents: list[bytes] = []
    size = 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])
    with os.scandir(folder) as found:
        for entry in found:
            with open(entry.path, "rb") as f:
                content = f.read()
            if not content:
                continue
            names.append(entry.name)
            contents.append(content)
            size += len(content)
            if len(names) >= FILES or size >= BATCH:
                yield batch()
                names, contents, size = [], [], 0
    if names:
        yield batch()


def waves(df: DataFrame) -> DataFrame:
    """name and content, a WAV file of 16 bits, from name, channels, rate and samples; null samples are none."""

    def rows(batches):
        for b in batches:
            got = [write_wav(c, r, s or []) for c, r, s in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["name", "content"])

    return df.select("name", "channels", "rate", "samples").mapInArrow(rows, "name string, content binary")
