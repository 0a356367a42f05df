"""Captures read in byte ranges against the sequential reader."""

import random
import struct

import pytest

from skriva.sources import capture, capture_ranges


def payloads(seed, n):
    """Payloads of which some hold whole captures, and some are larger than several ranges."""
    rnd = random.Random(seed)
    inner = capture.write_classic([(1_700_000_000 * 10**9 + i, bytes(20)) for i in range(40)])[24:]
    inner_blocks = capture.write_blocks([(1_700_000_000 * 10**9 + i, bytes(20)) for i in range(40)])
    out = []
    for i in range(n):
        kind = rnd.randrange(12)
        data = inner * 3 if kind == 0 else inner_blocks + bytes(rnd.randrange(4)) if kind == 1 else bytes(9000) if kind == 2 else rnd.randbytes(rnd.choice([0, 1, 40, 300]))
        out.append((1_700_000_000 * 10**9 + i * 1000, data))
    return out


def two_faces(rows, order):
    """A file of the block format whose second interface, with another link type and clock, is named half way."""
    block = lambda kind, body: struct.pack(f"{order}II", kind, 12 + len(body)) + body + struct.pack(f"{order}I", 12 + len(body))
    face = lambda link, resolution: block(1, struct.pack(f"{order}HHIHHB3xHH", link, 0, 0, 9, 1, resolution, 0, 0))
    out = [block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1)), face(1, 9)]
    for i, (at, data) in enumerate(rows):
        if i == len(rows) // 2:
            out.append(face(101, 6))
        which = i % 2 if i >= len(rows) // 2 else 0
        at = at // 1000 if which else at
        out.append(block(6, struct.pack(f"{order}IIIII", which, at >> 32, at & 0xFFFFFFFF, len(data), len(data)) + data + bytes(-len(data) % 4)))
    return b"".join(out)


def same(spark, folder, size):
    got = sorted(map(tuple, capture_ranges.read_ranges(spark, str(folder), size).collect()), key=repr)
    want = []
    for p in sorted(folder.iterdir()):
        with open(p, "rb") as f:
            want += list(capture.packets(str(p), f))
    assert got == sorted(want, key=repr)
    return got


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_all_forms_and_orders(spark, tmp_path):
    rows = payloads(1, 400)
    for order, name in (("<", "le"), (">", "be")):
        (tmp_path / f"{name}.pcap").write_bytes(capture.write_classic(rows, order=order))
        (tmp_path / f"{name}-nano.pcap").write_bytes(capture.write_classic(rows, order=order, nano=True))
        (tmp_path / f"{name}.pcapng").write_bytes(capture.write_blocks(rows, order=order))
        (tmp_path / f"{name}-faces.pcapng").write_bytes(two_faces(rows, order))
    assert len(same(spark, tmp_path, 4000)) == 8 * 401


def test_damage_cuts_and_odd_files(spark, tmp_path):
    rows = payloads(2, 120)
    whole, blocks = capture.write_classic(rows), capture.write_blocks(rows)
    files = {"empty": b"", "text": b"not one", "head": whole[:24], "half-head": whole[:11], "half-section": blocks[:7], "bare-section": blocks[:28], "cut": whole[:-3], "cut-in-head": whole[: -len(rows[-1][1]) - 9], "cut-block": blocks[:-5]}
    broken = bytearray(whole)
    broken[len(whole) // 2 : len(whole) // 2 + 3000] = b"\xff" * 3000
    files["broken"] = bytes(broken)
    files["two-sections"] = blocks + blocks
    files["bad-section"] = blocks[:4] + b"\x03" + blocks[5:]
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    same(spark, tmp_path, 2500)


def test_one_large_file_in_eight_ranges(spark, tmp_path):
    rnd = random.Random(3)
    big = [rnd.randbytes(1400) for _ in range(50)]
    rows = [(1_700_000_000 * 10**9 + i * 1000, big[i % 50]) for i in range(48_000)]
    (tmp_path / "large.pcap").write_bytes(capture.write_classic(rows))
    size = (tmp_path / "large.pcap").stat().st_size
    assert size > 64 << 20
    parts = capture_ranges.ranges(spark, str(tmp_path), -(-size // 8)).collect()
    assert len(parts) == 8 and all(5000 < r.n < 6500 for r in parts)
    read = capture_ranges.read_ranges(spark, str(tmp_path), -(-size // 8)).filter("seq is not null")
    got = read.selectExpr("count(*) n", "count(distinct seq) s", "max(seq) m", "bool_and(at_ns = 1700000000000000000 + seq * 1000) t", "sum(original_len) b").head()
    assert tuple(got) == (48_000, 48_000, 47_999, True, 48_000 * 1400)


@pytest.mark.parametrize("most", [1, 50, 90, 91])
def test_the_limit_of_packets(spark, tmp_path, monkeypatch, most):
    data = capture.write_classic(payloads(4, 90))
    (tmp_path / "many.pcap").write_bytes(data + b"\xff" * 40)
    got = sorted(map(tuple, capture_ranges.read_ranges(spark, str(tmp_path), 3000, most=most).collect()), key=repr)
    monkeypatch.setattr(capture, "MOST_PACKETS", most)
    with open(tmp_path / "many.pcap", "rb") as f:
        assert got == sorted(capture.packets(str(tmp_path / "many.pcap"), f), key=repr)


def test_small_ranges_share_tasks(spark):
    """The tasks are as many as a shuffle has, whatever the number of ranges; large ranges have one each."""
    assert capture_ranges.tasks(spark, [1 << 20] * 3, 1 << 10) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert capture_ranges.tasks(spark, [1 << 40], capture_ranges.RANGE) == 10_000 and capture_ranges.tasks(spark, [100 << 26], 1 << 26) == 100 and capture_ranges.tasks(spark, [], 1) == 1
