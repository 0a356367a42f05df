"""Pruned columns and pushed filters against the whole reader."""

import io
import random

import pytest
from pyspark.sql import functions as F

from skriva.sources import capture, capture_scan


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    got = 0

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data


def files():
    r = random.Random(2)
    rows = [(i * 10**9 + i, bytes(r.randrange(256) for _ in range(r.choice([0, 1, 60, 3000])))) for i in range(60)]
    blocks = capture.write_blocks(rows, order=">")
    return {"a": capture.write_classic(rows), "b": capture.write_classic(rows, order=">", nano=True), "c": blocks, "d": blocks[:-7], "e": capture.write_classic(rows)[:-1], "f": b"none", "g": capture.write_blocks(rows)[:4000], "h": b""}


@pytest.mark.parametrize("columns,options,rule", [
    ((), {}, "true"), ((), {"low": 5000000005, "high": 8999999999}, "at_ns >= 5000000005 and at_ns < 9000000000"), (("seq", "captured_len"), {}, "true"), (("file", "seq", "at_ns"), {"packets_only": True, "low": 50000000001}, "at_ns > 50000000000"),
    (("at_ns", "data"), {"low": 7000000000, "high": 7000000000}, "at_ns = 7000000000"), (("file", "error", "truncated"), {}, "true"), (("at_ns", "original_len"), {"packets_only": True}, "seq is not null"), (("at_ns", "link_type"), {"high": 2}, "at_ns <= 2"),
])
def test_as_the_whole_reader(spark, tmp_path, columns, options, rule):
    for name, content in files().items():
        (tmp_path / name).write_bytes(content)
    spark.dataSource.register(capture.CaptureSource)
    whole = spark.read.format("capture").load(str(tmp_path)).withColumn("captured_len", F.length("data").cast("long"))
    columns = columns or tuple(whole.columns)
    got = capture_scan.scan(spark, str(tmp_path), *columns, **options)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.filter(rule).select(*columns).collect()))
    if "file" in columns:
        # two plans over one table don't meet each other's filters
        one = got.filter(F.col("file") == str(tmp_path / "b")).count()
        assert one < got.count() == whole.filter(rule).count()


def test_unknown_columns(spark, tmp_path):
    capture_scan.scan(spark, str(tmp_path))
    with pytest.raises(Exception, match="no columns of a capture"):
        spark.read.format("capture_scan").schema("what int").load(str(tmp_path)).collect()


def test_bytes_that_are_read():
    """A packet's data is read only if it is wanted: heads are all else that is."""
    for name in "abc":
        content = files()[name]
        
        def read(columns, content=content, **options):
            reader, f = capture_scan._Reader({"path": "", **options}, list(columns)), Counted(content)
            return len(list(reader.rows("x", f, len(content)))), f.got

        assert read(["seq", "data"]) == (61, pytest.approx(len(content), abs=60 * 8))
        assert read(["seq", "at_ns", "captured_len"])[0] == 61 and read(["seq"])[1] < 60 * 32 + 200
        n, got = read(["data"], to=str(5 * 10**9 - 1))
        assert n == 5 and got < 60 * 32 + 200 + 5 * 3020
