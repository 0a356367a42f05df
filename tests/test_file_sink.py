"""Runs of files that are whole or not there."""

import glob
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from skriva.sources import file_sink


def _all(folder):
    return {os.path.basename(p): open(p, "rb").read() for p in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(p)}


def test_run_is_written_once(spark, tmp_path):
    """Strings, bytes, nulls, any letters in a name; the same run again changes nothing, another is added."""
    df = spark.createDataFrame([("a.txt", "é\n"), ("b c%20ü.txt", None), ("d", "x" * 3_000_000)], "name string, content string").withColumn("other", F.lit(1))
    file_sink.write_files(df, str(tmp_path), "one")
    want = {"a.txt": "é\n".encode(), "b c%20ü.txt": b"", "d": b"x" * 3_000_000}
    assert _all(tmp_path) == want
    file_sink.write_files(df.withColumn("content", F.lit("new")), str(tmp_path), "one")
    file_sink.write_files(df.filter("false"), str(tmp_path), "none")
    assert _all(tmp_path) == want and os.listdir(tmp_path / "run=none") == [] and os.listdir(tmp_path / "_pending") == []
    assert {r.name: bytes(r.content) for r in file_sink.read_files(spark, str(tmp_path), "one").collect()} == {k: v for k, v in want.items() if v}


def test_tasks_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    """A shuffle's tasks write the files, however few bytes they have, and as many read them back, in batches."""
    monkeypatch.setattr(file_sink, "FILES", 7)
    df = spark.range(600).selectExpr("concat('f', id) AS name", "cast(id AS string) AS content")
    file_sink.write_files(df, str(tmp_path), "r")
    assert len(os.listdir(tmp_path / "run=r")) == 4
    back = file_sink.read_files(spark, str(tmp_path), "r")
    assert back.rdd.getNumPartitions() == 4
    assert {r.name: bytes(r.content) for r in back.collect()} == {f"f{i}": str(i).encode() for i in range(600)}
    with pytest.raises(FileNotFoundError):
        file_sink.read_files(spark, str(tmp_path), "none")


@pytest.mark.parametrize("names", [["a", "a"], ["a", None], ["a", "../b"], ["a", ".."], ["a", ""], ["a", "_b"]])
def test_bad_names_leave_nothing(spark, tmp_path, names):
    df = spark.createDataFrame([(n, "x") for n in names], "name string, content string")
    with pytest.raises(Exception, match="name of a file|exists"):
        file_sink.write_files(df, str(tmp_path), "one")
    assert _all(tmp_path) == {} and not os.path.exists(tmp_path / "run=one")


def test_tasks_that_die_are_made_again(tmp_path):
    """The first attempt of each task is killed, worker and all, after it has written files: each is there once, and whole."""
    code = """
        import os, sys
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from skriva.sources import file_sink
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.adaptive.enabled", "false").getOrCreate()
        plain = file_sink._Writer.write
        def write(self, iterator):
            done = plain(self, iterator)
            if TaskContext.get().attemptNumber() == 0:
                os._exit(1)
            return done
        class Dying(file_sink._Writer):
            write = write
        class Source(file_sink.NamedFiles):
            def writer(self, schema, overwrite):
                return Dying(self.options["path"], self.options["run"])
        file_sink.NamedFiles = Source
        df = spark.range(500).selectExpr("concat('f', id) AS name", "repeat(cast(id AS string), 1000) AS content")
        file_sink.write_files(df, sys.argv[1], "r")
    """
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    got = subprocess.run([sys.executable, "-c", textwrap.dedent(code), str(tmp_path)], env=env, capture_output=True, text=True, timeout=180)
    assert got.returncode == 0, got.stderr[-3000:]
    paths = [p for p in glob.glob(f"{tmp_path}/**", recursive=True) if os.path.isfile(p)]
    assert len(paths) == 500 and _all(tmp_path) == {f"f{i}": (str(i) * 1000).encode() for i in range(500)}
    assert "exited unexpectedly" in got.stderr or "crashed" in got.stderr or "EOF" in got.stderr
