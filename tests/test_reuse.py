"""Results by fingerprint: what is made again, and what an unfinished run leaves."""

import os

import pytest
from pyspark.sql import functions as F

from skriva.operators import reuse


def upper(df):
    return df.select("fingerprint", F.upper("text").alias("result"))


def wanted(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("fingerprint", F.sha2("text", 256))


def test_only_what_changed_is_made(spark, tmp_path):
    store, seen = str(tmp_path / "store"), []

    def make(df):
        seen.append(sorted(r.text for r in df.collect()))
        return upper(df)

    first = [f"t{i}" for i in range(200)] + ["t7", None]
    got = {r.i: (r.result, r.reused) for r in reuse.results(wanted(spark, first), make, store).collect()}
    assert got == {i: (t and t.upper(), False if t else None) for i, t in enumerate(first)}
    second = [t if i % 100 else f"new{i}" for i, t in enumerate(first)]
    got = {r.i: (r.result, r.reused) for r in reuse.results(wanted(spark, second), make, store).collect()}
    assert got == {i: (t and t.upper(), None if t is None else not t.startswith("new")) for i, t in enumerate(second)}
    assert len(seen[0]) == 200 and seen[1:] == [["new0", "new100", "new200"]]
    again = reuse.results(wanted(spark, first), make, store).collect()
    assert all(r.reused for r in again if r.text) and len(seen) == 2 and sorted(os.listdir(store)) == ["1", "2"]


def test_a_failed_run_leaves_the_store_as_it_was(spark, tmp_path):
    store = str(tmp_path / "store")
    reuse.results(wanted(spark, ["a"]), upper, store).collect()
    with pytest.raises(Exception, match="stop here"):
        reuse.results(wanted(spark, ["a", "b"]), lambda df: df.select("fingerprint", F.raise_error(F.lit("stop here")).cast("string").alias("result")), store)
    assert reuse.snapshots(spark, store)[0] == [1]
    os.makedirs(f"{store}/5")  # a snapshot that a lost driver began
    got = {r.text: (r.result, r.reused) for r in reuse.results(wanted(spark, ["a", "b"]), upper, store).collect()}
    assert got == {"a": ("A", True), "b": ("B", False)} and reuse.snapshots(spark, store)[0] == [1, 6]
