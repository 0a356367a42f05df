"""Growing captures: each packet once, whatever the cuts, against the sequential reader."""

import random

from skriva.sources import capture, capture_stream


def sequential(path):
    with open(path, "rb") as f:
        return [r for r in capture.packets(str(path), f) if r[1] is not None]


def step(reader, was, tasks=None):
    """The rows between two offsets, as the executors read them."""
    now = reader.latestOffset()
    pieces = reader.partitions(was, now)
    if tasks is not None:
        tasks.append(len(pieces))
    return now, [tuple(r) for p in pieces for r in reader.read(p)]


def test_files_that_grow_at_any_byte(tmp_path):
    rnd = random.Random(1)
    rows = [(1_700_000_000 * 10**9 + i * 1000, rnd.randbytes(rnd.choice([0, 3, 40, 200]))) for i in range(120)]
    files = {"a.pcap": capture.write_classic(rows), "b.pcap": capture.write_classic(rows[:50], order=">", nano=True), "c.pcapng": capture.write_blocks(rows, order=">"), "d.pcapng": capture.write_blocks(rows[:1])}
    reader, was, got, tasks = capture_stream._Reader({"path": str(tmp_path), "rangeBytes": "200"}), {}, [], []
    sizes = dict.fromkeys(files, 0)
    while any(sizes[n] < len(files[n]) for n in files):
        for n in files:
            sizes[n] = min(len(files[n]), sizes[n] + rnd.randrange(900))
            (tmp_path / n).write_bytes(files[n][: sizes[n]])
        if rnd.random() < 0.3:  # a restart: the reader knows nothing, the offset is kept
            reader = capture_stream._Reader({"path": str(tmp_path), "rangeBytes": "200"})
        was, new = step(reader, was, tasks)
        got += new
    assert sorted(got, key=repr) == sorted((r for n in files for r in sequential(tmp_path / n)), key=repr)
    assert max(tasks) > len(files) and step(reader, was)[1] == []


def test_damage_is_told_once(tmp_path):
    good = capture.write_classic([(10**9 * i, bytes(9)) for i in range(3)])
    (tmp_path / "bad.pcap").write_bytes(good + b"\xff" * 40)
    (tmp_path / "text.txt").write_bytes(b"no capture at all, but some text")
    (tmp_path / "empty.pcap").write_bytes(b"")
    reader = capture_stream._Reader({"path": str(tmp_path)})
    was, got = step(reader, {})
    assert [r[1] for r in got if r[8] is None] == [0, 1, 2]
    assert sorted(r[8] for r in got if r[8]) == ["damaged: a packet of impossible length", "not a capture"]
    with open(tmp_path / "bad.pcap", "ab") as f:
        f.write(good)
    assert step(reader, was)[1] == []


def test_as_a_stream(spark, tmp_path):
    rows = [(1_700_000_000 * 10**9 + i * 1000, bytes([i])) for i in range(60)]
    content, folder = capture.write_classic(rows), tmp_path / "in"
    folder.mkdir()
    spark.dataSource.register(capture_stream.CaptureStream)
    got = []
    for size in (len(content) // 2, len(content)):  # the second run starts from the first one's checkpoint
        (folder / "x.pcap").write_bytes(content[:size])
        df = spark.readStream.format("capture_stream").option("rangeBytes", 300).load(str(folder))
        q = df.writeStream.foreachBatch(lambda b, i: got.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        q.awaitTermination(60)
        q.stop()
    plain = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got]
    assert sorted(plain, key=repr) == sorted(sequential(folder / "x.pcap"), key=repr)
