"""Token-id output: frequency-ranked ids in a byte-aligned code whose control bytes stand apart.

A text is cut before each lone space and around each lone newline (one without white space beside it), and
between a letter and a mark. A byte-level BPE takes no pair across such a place, so the ids of the parts, joined, are the ids of the
text; each worker keeps the ids of the parts it saw last. The corpus counts of all ids give each a rank, the commonest 0.

A file holds blocks, each ended by a newline. A block: MAGIC, bucket, number in the bucket, ids of the
bucket before it, documents, ids, bytes of control and of data (unsigned 64-bit, little-endian); then
per document its id (int64), whether that is null (byte) and its number of ids (int64); then the
control bytes, four 2-bit lengths less one in each; then the ranks, little-endian, 1 to 4 bytes each.
Buckets, and documents in them, ascend by doc_id (null first); equal doc_ids stand in order of their ids.

A folder of ids stands alone: blocks/ holds these files and ranks/ a table of the id of each rank.

Null text: empty. Empty text: the end id alone. An empty table: no files, no rows. Null doc_ids come first;
equal rows have equal ids, one after the other. A text of any length is one document. Other columns aren't read.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

MAGIC = b"SKVB"
HEAD = struct.Struct("<4s7Q")
#: Parts whose ids a worker keeps at once, ids in a block, and blocks in a file.
PARTS, BLOCK, PER_FILE = 200_000, 1 << 20, 16
#: A part of more code points isn't kept beyond its batch.
LONG = 200
_WHITE = shared.SPACE.copy()
_WHITE[0x1C:0x20] = True
_MARK = np.zeros(256, bool)
_MARK[list(b",.;:!?")] = True
#: ASCII letters; of the others, those of the Latin-1 block are known by their two bytes.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: The lengths that a control byte names.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


class Encoder:
    """UTF-8 text to unsigned 32-bit ids, with the tokenizers library.

    The parts of a piece of text are told apart by hash, so that only one of each is looked up, by its
    text, in the ids of the parts seen last (two generations of a bounded cache). What is new reaches the
    library many words in a call.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.encode_special_tokens = True
        #: Which ids begin with a space: a word of letters after a space begins with one and has no other.
        self.leads = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.leads[[i for t, i in self.library.get_vocab().items() if t.startswith("\u0120")]] = True
        self.parts: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts."""
        gc.disable()  # millions of small objects without cycles are made here; workers are reused, so it goes on again
        try:
            return self._learn(parts)
        finally:
            gc.enable()

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        if len(self.parts) > PARTS:
            self.old, self.parts = self.parts, {}
        found = list(map(self.parts.get, parts))
        missed = [i for i, x in enumerate(found) if x is None]
        if missed:
            names = [parts[i] for i in missed]
            got = list(map(self.old.get, names)) if self.old else [None] * len(names)
            fresh = [j for j, ids in enumerate(got) if ids is None]
            for j, ids in zip(fresh, self._encode([names[j].decode("utf-8", "replace") for j in fresh]), strict=True):
                got[j] = ids
            for i, ids in zip(missed, got, strict=True):
                found[i] = ids
            # what the younger generation had is there: only what it hadn't comes in
            self.parts.update((p, ids) for p, ids in zip(names, got, strict=True) if len(p) <= LONG)
        return found

    def _encode(self, new: list[str]) -> list[bytes]:
        made: list = [None] * len(new)
        words = [i for i, a in enumerate(new) if a[:1] == " " and a[1:].isalpha()]
        for some in shared.chunked(shared.chunked(words, 128), 64):
            for group, e in zip(some, self.library.encode_batch_fast(["".join([new[i] for i in g]) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                at = np.flatnonzero(self.leads[ids])
                if len(at) == len(group):
                    data, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                    for i, j, k in zip(group, at, at[1:]):  # noqa: B905
                        made[i] = data[j:k]
        for some in shared.chunked([i for i, x in enumerate(made) if x is None], 4096):
            for i, e in zip(some, self.library.encode_batch_fast([new[i] for i in some], add_special_tokens=False), strict=True):
                made[i] = np.array(e.ids, "<u4").tobytes()
        return made

    def texts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids by text)."""
        starts = parts(buf, off)
        ends = np.append(starts[1:], len(buf))
        _, first, which = np.unique(shared.hashes(buf, starts, ends), return_index=True, return_inverse=True)
        data = buf.tobytes()
        found = self.learn([data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        pool = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        sizes = size[which]
        begin = (np.cumsum(size) - size)[which] - (np.cumsum(sizes) - sizes)
        ids = pool[np.repeat(begin, sizes) + np.arange(sizes.sum())]
        return ids, shared.row_sums(sizes, np.diff(np.searchsorted(starts, off)))


_CODERS: dict[str, Encoder] = {}


def coder_of(vocabulary: str) -> Encoder:
    """The worker's own encoder: it and the parts it saw last outlive a task."""
    if vocabulary not in _CODERS:
        _CODERS[vocabulary] = Encoder(vocabulary)
    return _CODERS[vocabulary]


def forget() -> None:
    """Lets the worker's encoders go: a task that needs none shouldn't keep their parts beside its own data."""
    _CODERS.clear()


def white(buf: np.ndarray) -> np.ndarray:
    """Which bytes are of white space of any kind."""
    out = _WHITE[buf]
    if buf.max(initial=0) >= 0xC2:
        pad = np.concatenate([buf, np.zeros(2, np.uint8)])
        b, c = pad[1:-1], pad[2:]
        two = (buf == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (buf == 0xE2) & ((b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        three |= (buf == 0xE1) & (b == 0x9A) & (c == 0x80) | (buf == 0xE3) & (b == 0x80) & (c == 0x80)
        for at in (np.flatnonzero(two | three), np.flatnonzero(two | three) + 1, np.flatnonzero(three) + 2):
            out[at] = True
    return out


def parts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the parts begin: at each text, each lone space, and each mark after a letter; at and after each lone newline."""
    w = white(buf)
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    alone = w.copy()
    alone[1:] &= ~w[:-1] & ~edge[1:-1]
    alone[:-1] &= ~w[1:] & ~edge[1:-1]
    if len(buf):
        alone[0] = alone[-1] = False
    edge[:-1] |= alone & (buf == 32)
    line = np.flatnonzero(alone & (buf == 10))
    edge[line] = edge[line + 1] = True
    letter = _LETTER[buf]
    letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    edge[1:-1] |= letter[:-1] & _MARK[buf[1:]]
    return np.flatnonzero(edge[:-1])


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned ranks."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = np.ascontiguousarray(ranks, "<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4, dtype=np.uint8) < size[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks, from a table of lengths by control byte."""
    size = LENGTHS[control].reshape(-1)[:n]
    end = np.cumsum(size, dtype=np.int64)
    at = end - size
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    out = data[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(bucket: int, number: int, before: int, ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = HEAD.pack(MAGIC, bucket, number, before, len(ids), len(ranks), len(control), len(data))
    null = np.array([i is None for i in ids], np.uint8)
    keys = np.array([i or 0 for i in ids], "<i8")
    return head + keys.tobytes() + null.tobytes() + counts.astype("<i8").tobytes() + control + data


def blocks(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(bucket, ids before, document ids, counts, ranks) of each block of a file."""
    at = 0
    while at < len(content):
        magic, bucket, _, before, docs, n, c, d = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("this isn't a file of token ids")
        at += HEAD.size
        keys = np.frombuffer(content, "<i8", docs, at).tolist()
        null = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
        counts = np.frombuffer(content, "<i8", docs, at + 9 * docs)
        at += 17 * docs
        control, data = np.frombuffer(content, np.uint8, c, at), np.frombuffer(content, np.uint8, d, at + c)
        at += c + d + 1
        yield bucket, before, [None if x else k for k, x in zip(keys, null, strict=True)], counts, unpack(control, data, n)


def encode(docs: DataFrame, vocabulary: str, end_id: int = 2, id_column: str = "doc_id", text: str = "text", folder: str | None = None) -> str:
    """Writes the ids of all texts, and end_id after each; returns the folder, a new one of the shared folder if none is given.

    At scale: one pass tokenises; its ids, packed, are a table in the shared folder, so that neither the
    count nor the sort by doc_id makes it again. What the driver gets are the counts of the vocabulary's
    ids and the bounds of the buckets.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = docs.count()
    n = max(1, min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 8192)))
    bounds = sorted(set(docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n))) if rows and n > 1 else []
    wide = 2 if max(end_id, Encoder(vocabulary).library.get_vocab_size()) <= 0xFFFF else 4
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def tokens(batches):
        coder, seen = coder_of(vocabulary), np.zeros(1 << 16, np.int64)
        for rows, buf, off in shared.pieces(batches):
            keys = rows.column(0).to_pylist()
            ids, counts = coder.texts(buf, off)
            ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype(f"<u{wide}"), counts + 1
            count = np.bincount(ids)
            if len(count) > len(seen):
                seen = np.concatenate([seen, np.zeros(len(count) - len(seen), np.int64)])
            seen[: len(count)] += count
            small = [pa.compress(x, "zstd", asbytes=True) for x in np.split(ids, np.cumsum(counts)[:-1])]
            yield shared.as_batch(["bucket", "doc_id", "ids", "n", "k"], [[0 if k is None else bisect_right(bounds, k) for k in keys], keys, small, counts, [None] * len(keys)], kinds)
        k = np.flatnonzero(seen)
        yield shared.as_batch(["bucket", "doc_id", "ids", "n", "k"], [[None] * len(k), [None] * len(k), [None] * len(k), seen[k], k], kinds)

    coded = shared.written(shared.arrow(docs, tokens, "bucket int, doc_id long, ids binary, n long, k long"))
    counts = coded.filter("k is not null").groupBy("k").agg(F.sum("n").alias("n")).collect()
    order = [r.k for r in sorted(counts, key=lambda r: (-r.n, r.k))]
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    rank_of = spark.sparkContext.broadcast(rank)

    def files(batches):
        state: dict = {"bucket": None}

        def flush():
            if state["bucket"] is None or not state["ids"]:
                return
            ids = np.concatenate(state["ids"])
            made = block(state["bucket"], state["number"], state["before"], state["keys"], np.array([len(x) for x in state["ids"]]), rank_of.value[ids])
            state["before"] += len(ids)
            state["number"] += 1
            state["ids"], state["keys"], state["n"] = [], [], 0
            yield shared.as_batch(["bucket", "block"], [[state["bucket"]], [made]], [pa.int32(), pa.large_binary()])

        for batch in batches:
            for bucket, key, ids, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != state["bucket"]:
                    yield from flush()
                    state = {"bucket": bucket, "number": 0, "before": 0, "ids": [], "keys": [], "n": 0}
                state["ids"].append(np.frombuffer(pa.decompress(ids, wide * n, "zstd", asbytes=True), f"<u{wide}").astype(np.uint32))
                state["keys"].append(key)
                state["n"] += n
                if state["n"] >= BLOCK:
                    yield from flush()
        yield from flush()

    folder = folder or shared.scratch(spark)
    table = pa.table({"rank": pa.array(range(len(order)), pa.int64()), "id": pa.array(order, pa.int64())})  # as long as the vocabulary at most
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{folder}/ranks")
    sorted_rows = coded.filter("k is null").select("bucket", "doc_id", "ids", "n").repartition(n, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "n", "ids")
    made = shared.arrow(sorted_rows, files, "bucket int, block binary").select("bucket", F.col("block").cast("string").alias("value"))
    made.write.partitionBy("bucket").option("maxRecordsPerFile", PER_FILE).option("compression", "none").text(f"{folder}/blocks")
    shared.drop(coded)
    return folder


def _documents(spark: SparkSession, folder: str, schema: str, made: Callable[[list[bytes]], list[list]]) -> DataFrame:
    """bucket, doc_id, start in the bucket and what made() gives for the ids of each document in the files of a folder."""
    order = [r.id for r in spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").orderBy("rank").collect()]
    if not order:
        return spark.createDataFrame([], schema)
    ids_of = spark.sparkContext.broadcast(np.array(order, np.uint32))
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                for bucket, before, keys, counts, ranks in blocks(content.as_buffer().to_pybytes()):
                    ids = ids_of.value[ranks].astype("<u4")
                    end = np.cumsum(counts)
                    out = [ids[e - c : e].tobytes() for e, c in zip(end.tolist(), counts.tolist(), strict=True)]
                    yield shared.as_batch(names, [[bucket] * len(keys), keys, before + end - counts, *made(out)], kinds)

    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/blocks").select("content")
    return shared.arrow(content, rows, schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, doc_id, start in the bucket, ids) of each document in the files of a folder."""
    return _documents(spark, folder, "bucket int, doc_id long, start long, ids binary", lambda ids: [ids])


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    digest = lambda ids: [[len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids]]
    back = shared.kept(_documents(spark, folder, "bucket int, doc_id long, start long, n_tokens long, ids_crc32 long", digest))
    total = back.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))  # a row for each bucket, 20,000 at most
    before = total.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    return back.join(F.broadcast(before), "bucket").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
