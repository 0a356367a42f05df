"""Bounded tables over a stream against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from skriva.operators import flows
from skriva.streaming import bounded

CAP = {"conversations": 12, "hosts": 9, "queries": 3}
SCHEMA = "file string, seq long, kind string, src string, dst string, src_key binary, dst_key binary, src_port int, dst_port int, proto_ord int, proto_num int, query string"


def made(n, seed):
    """Packets of two files: one with more keys than the tables hold, one with fewer and without names."""
    rnd, out = random.Random(seed), []
    for file, hosts, named in (("big", 40, True), ("small", 4, False)):
        for seq in range(n):
            a, b = rnd.sample(range(hosts), 2)
            kind = rnd.choice(["ip"] * 5 + ["arp", None])
            asked = f"name{rnd.randrange(8)}" if named and rnd.random() < 0.2 else None
            out.append((file, seq, kind, f"10.0.0.{a}", f"10.0.0.{b}", bytes([4, a]), bytes([4, b]), rnd.choice([None, 53]), 80, 1, 17, asked))
    return out


def run(spark, folder, held, **kw):
    """The rows of each batch so far, in order of batches."""
    got = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = bounded.capped_stream(stream, held, **kw).writeStream.outputMode("update").foreachBatch(lambda df, i: got.extend((i, *r) for r in df.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return got


def newest(rows):
    out = {}
    for _, file, kind, held, overflow, settled in rows:
        if (file, kind) in out and out[file, kind][2]:
            assert settled and held == out[file, kind][0] and overflow >= out[file, kind][1]
        out[file, kind] = (held, overflow, settled)
    return out


def test_shuffled_batches_and_a_restart(spark, tmp_path):
    rows = made(300, 1)
    random.Random(2).shuffle(rows)
    seen, so_far = [], []
    for i in range(4):
        part = rows[i * 150 : (i + 1) * 150]
        so_far += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i % 2:  # another run each second batch goes on from the state of the one before
            seen += run(spark, tmp_path, CAP)
            want = {(r.file, r.kind): (r.held, r.overflow) for r in flows.capped(spark.createDataFrame(so_far, SCHEMA), CAP).collect()}
            got = newest(seen)
            assert {k: v[:2] for k, v in got.items()} == want
    assert ("small", "queries") not in got
    assert got["big", "conversations"][1] > 0 and got["big", "hosts"][2] and not got["small", "hosts"][2]


def test_a_gap_is_waited_for_within_reach(spark, tmp_path):
    """Packet 0 never comes: the tables settle once it is more than reach behind."""
    rows = [r for r in made(120, 3) if r[0] == "big" and r[1] > 0]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    assert not any(s for _, _, s in newest(run(spark, tmp_path, CAP)).values())
    again = tmp_path / "again"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{again}/in")
    got = newest(run(spark, again, CAP, reach=20))
    want = {(r.file, r.kind): (r.held, r.overflow) for r in flows.capped(spark.createDataFrame(rows, SCHEMA), CAP).collect()}
    assert {k: v[:2] for k, v in got.items()} == want and all(s for _, _, s in got.values())


def test_nothing_and_no_limit(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path, CAP) == []
    spark.createDataFrame([r[:1] + (None,) + r[2:] for r in made(5, 1)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path, CAP) == []


@pytest.mark.parametrize("spans, want", [([], []), ([(3, 5), (0, 2), (2, 3)], [(0, 5)]), ([(4, 6), (0, 2), (1, 2)], [(0, 2), (4, 6)])])
def test_merged(spans, want):
    assert bounded.merged(spans) == want


def test_an_idle_file_is_forgotten(spark, tmp_path):
    import time

    rows = [r for r in made(60, 5) if r[0] == "big"]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    first = newest(run(spark, tmp_path, CAP, idle_ms=1))
    time.sleep(1)
    spark.createDataFrame([("other", 0, "ip", "10.0.0.1", "10.0.0.2", b"\x04\x01", b"\x04\x02", 1, 2, 1, 17, None)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, tmp_path, CAP, idle_ms=1)  # its batch also ends the idle file
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert newest(run(spark, tmp_path, CAP, idle_ms=1)) == first


def test_a_state_takes_in_runs_in_one_piece(spark, tmp_path, monkeypatch):
    """A batch of 6,000 packets with holes: one row of runs for each kind, and no run beyond the last admitted key is kept."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("place", pa.int64()), ("n", pa.int64())])
    places = [i * 2 for i in range(3000)]
    rows = pa.RecordBatch.from_arrays([pa.array(["f"] * 6000), pa.array([None] * 3000 + ["hosts"] * 3000), pa.array([None] * 3000 + [f"k{i % 50}" for i in range(3000)]), pa.array(places + [2 * p for p in places]), pa.array([0] * 3000 + [1] * 3000)], schema=schema)
    got = pa.Table.from_batches(bounded._combined(iter([rows.slice(i, 500) for i in range(0, 6000, 500)]))).to_pylist()
    keys = {r["key"]: (r["first"], r["n"]) for r in got if r["key"]}
    assert keys == {f"k{i}": (4 * i, 60) for i in range(50)} and len(got) == 50 + len(bounded.PLACES)
    assert all(np.frombuffer(r["runs"], "<i8").reshape(2, -1).tolist() == [places, [p + 1 for p in places]] for r in got if not r["key"])
    kept = {}

    class Value:
        def __init__(self, name):
            self.name = name

        exists = lambda self: self.name in kept
        get = lambda self: kept[self.name]
        update = lambda self, value: kept.__setitem__(self.name, value)

    class Handle:
        getValueState = lambda self, name, _: Value(name)  # noqa: E731, N815
        listTimers = lambda self: []  # noqa: E731, N815
        registerTimer = lambda self, _: None  # noqa: E731, N815

    class Now:
        getCurrentProcessingTimeInMs = lambda self: 0  # noqa: E731, N815

    import pandas as pd

    state = bounded.Tables({"hosts": 9}, 1 << 40, 1)
    state.init(Handle())
    told = [r for df in state.handleInputRows(("f", "hosts"), iter([pd.DataFrame([r for r in got if r["kind"] == "hosts"])]), Now()) for r in df.itertuples(index=False)]
    assert [tuple(r) for r in told] == [("f", "hosts", 9, 41 * 60, False)]
    runs, newest = kept["order"]
    assert newest == 5999 and len(runs) // 16 == 9  # packets 0 to 16, every other one
