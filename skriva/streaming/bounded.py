"""Bounded tables over a stream of decoded packets: what flows.capped() says of a file, kept up to date.

A table admits keys in the order of their first packet, and packets reach a stream in any order. So the state of a file
and kind holds each key's first place and its weight only while the order is open: once all packets up to the last
admitted key's first have been seen, no later one can take its place, and from then on the state is the admitted keys
and two counters. Of the packets' numbers it holds the runs up to the last admitted key's first alone, as soon as there
are so many keys. Rows are pre-aggregated by key within runs of ROWS rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import flows

#: Packets behind the newest of a file that may still come out of order; an hour without packets ends a file.
REACH, IDLE_MS = 1_000_000, 3_600_000
#: Places of a packet within each kind's order: a host's packet has a source and a destination.
PLACES = {"conversations": 1, "hosts": 2, "queries": 1}
#: Sightings that a task combines at a time, and rows that a state takes in at a time.
ROWS = 1 << 18
_PART = "file string, kind string, key string, first long, n long, runs binary"
_OUT = "file string, kind string, held long, overflow long, settled boolean"


def _sightings(packets: DataFrame) -> DataFrame:
    """(file, kind, key, place, weight) of every sighting, and one row without a kind for every packet."""
    sight = lambda kind, key, place, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), place.cast("long").alias("place"), F.lit(n).cast("long").alias("n"))
    end = lambda x: F.concat_ws(" ", F.col(x), F.coalesce(f"{x}_port", F.lit(0)))
    ends = F.array_sort(F.array(end("src"), end("dst")))
    seq, ip = F.col("seq"), F.col("kind") == "ip"
    always = F.array(sight(None, F.lit(None).cast("string"), seq, 0))
    of_ip = F.array(
        sight("conversations", F.concat_ws(" ", ends, F.col("proto_ord"), F.col("proto_num")), seq, 1),
        sight("hosts", F.col("src"), seq * 2, 1),
        sight("hosts", F.col("dst"), seq * 2 + 1, 1),
    )
    asked = F.array(sight("queries", F.col("query"), seq, 0))
    nothing = F.slice(always, 1, 0)
    every = F.concat(always, F.when(ip, of_ip).otherwise(nothing), F.when(ip & F.col("query").isNotNull(), asked).otherwise(nothing))
    return packets.filter("seq is not null").select("file", F.explode(every).alias("x")).select("file", "x.*")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with first place and weight; a row without a key for each file and kind: runs of packet numbers, all starts and then all ends."""
    schema = pa.schema([("file", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("runs", pa.binary())])

    def flush(held):
        rows = pa.Table.from_batches(held)
        packet = rows["kind"].is_null()
        keyed = rows.filter(pa.compute.invert(packet)).group_by(["file", "kind", "key"], use_threads=False).aggregate([("place", "min"), ("n", "sum")])
        names = ["file", "kind", "key", "place_min", "n_sum"]
        yield from pa.Table.from_arrays([*(keyed[c] for c in names), pa.nulls(len(keyed), pa.binary())], schema=schema).to_batches(10_000)
        of = rows.filter(packet).select(["file", "place"])
        for file in pa.compute.unique(of["file"]).to_pylist():
            mine = of.filter(of["file"].is_null() if file is None else pa.compute.equal(of["file"], file))
            at = np.asarray(mine["place"])
            told = np.concatenate(joined(at, at + 1)).astype("<i8").tobytes()
            k = len(PLACES)
            yield pa.RecordBatch.from_arrays([pa.array([file] * k, pa.string()), pa.array(list(PLACES)), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([told] * k, pa.binary())], schema=schema)

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= ROWS:
            yield from flush(held)
            held = []
    if held:
        yield from flush(held)


def joined(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs from lo to before hi, in order, with those that touch as one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    new = np.append(True, lo[1:] > hi[:-1])[: len(lo)]
    return lo[new], hi[np.append(new[1:], True)[: len(hi)]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """joined() of pairs."""
    lo, hi = joined(*np.array(spans, np.int64).reshape(-1, 2).T)
    return list(zip(lo.tolist(), hi.tolist(), strict=True))


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


_KEYS = pa.schema([("key", pa.large_string()), ("first", pa.int64()), ("n", pa.int64())])


def _united(parts: list[pa.Table]) -> pa.Table:
    """Each key once, with its first place and its weight."""
    rows = pa.concat_tables(parts).group_by("key", use_threads=False).aggregate([("first", "min"), ("n", "sum")])
    return pa.Table.from_arrays([rows[c] for c in ("key", "first_min", "n_sum")], schema=_KEYS)


class Tables(StatefulProcessor):
    def __init__(self, held: dict[str, int], reach: int, idle_ms: int):
        self.held, self.reach, self.idle_ms = held, reach, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.table = handle.getValueState("table", "rows binary")
        self.order = handle.getValueState("order", "runs binary, newest bigint")
        self.told = handle.getValueState("told", "overflow bigint, settled boolean")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        file, kind = key
        overflow, settled = self.told.get() if self.told.exists() else (0, False)
        table = pa.ipc.open_stream(bytes(self.table.get()[0])).read_all() if self.table.exists() else _KEYS.empty_table()
        runs, newest = self.order.get() if self.order.exists() else (b"", 0)
        lo, hi = np.frombuffer(bytes(runs), "<i8").reshape(2, -1)
        parts, spans, waiting = [table], [(lo, hi)], 0
        for df in rows:
            told = df["runs"].notna()
            if not settled:
                spans += [np.frombuffer(bytes(x), "<i8").reshape(2, -1) for x in df.loc[told, "runs"]]
            keyed = df.loc[~told]
            if settled:
                overflow += int(keyed.loc[~keyed["key"].isin(table["key"].to_pylist()), "n"].sum())
            elif len(keyed):
                parts.append(pa.Table.from_arrays([pa.array(keyed["key"], pa.large_string()), pa.array(keyed["first"].astype("int64")), pa.array(keyed["n"].astype("int64"))], schema=_KEYS))
                waiting += len(keyed)
                if waiting > ROWS + parts[0].num_rows:
                    parts, waiting = [_united(parts)], 0
        most = self.held[kind]
        if not settled:
            table = _united(parts)
            lo, hi = joined(*(np.concatenate(x) for x in zip(*spans, strict=True)))
            newest = max(newest, int(hi[-1]) if len(hi) else 0)
            # all packets before low are here, or too far behind the newest one to be waited for
            low = max(int(hi[0]) if len(lo) and lo[0] == 0 else 0, newest - self.reach)
            first, n = np.asarray(table["first"]), np.asarray(table["n"])
            inside = np.argsort(first, kind="stable")
            overflow = int(n[inside[most:]].sum())
            end = None  # the packet whose place is that of the last admitted key
            if len(first) >= most:
                end = int(first[inside[most - 1]]) // PLACES[kind] if most else -1
                if end < low:
                    settled, table = True, table.take(inside[:most])
            if settled:
                lo, hi = lo[:0], hi[:0]
            else:
                if low:
                    lo, hi = joined(np.append(0, lo[hi > low]), np.append(low, hi[hi > low]))
                if end is not None:  # no later key is admitted by a packet beyond it
                    lo, hi = lo[lo <= end], hi[lo <= end]
            self.table.update((_packed(table),))
            self.order.update((np.concatenate([lo, hi]).astype("<i8").tobytes(), newest))
        self.told.update((overflow, settled))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if table.num_rows:
            yield pd.DataFrame([(file, kind, min(table.num_rows, most), overflow, settled)], columns=["file", "kind", "held", "overflow", "settled"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.table.clear()
        self.order.clear()
        self.told.clear()
        return iter(())


def capped_stream(packets: DataFrame, held: dict[str, int] | None = None, reach: int = REACH, idle_ms: int = IDLE_MS) -> DataFrame:
    """file, kind, held and overflow as in flows.capped(), once for each batch that has packets of the file; settled says
    that held will not change and that overflow can only grow.

    packets: a stream as flows.py describes it, seq from 0 by file, each packet once and in any order. The newest row of a
    file and kind equals flows.capped() over all packets so far, as long as none comes more than reach packets behind the
    newest of its file. A kind without a key has no row; rows without a seq count nothing. A file without packets for
    idle_ms is forgotten: packets that come later begin new tables. State of a file: the tables, and what came out of order
    within reach. Needs the RocksDB state store, and that batches without data don't run (timers would ask for them without
    end, and a run over what is there would never finish): this sets both for the session. So an idle file is forgotten
    with the next batch that has packets of any file.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    packets.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    parts = _sightings(packets).mapInArrow(_combined, _PART)
    tables = Tables(flows.HELD | (held or {}), reach, idle_ms)
    return parts.groupBy("file", "kind").transformWithStateInPandas(statefulProcessor=tables, outputStructType=_OUT, outputMode="Update", timeMode="ProcessingTime")
