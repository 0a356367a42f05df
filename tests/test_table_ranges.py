"""Delimited files in byte ranges against the reader of whole files."""

import random

import pytest

from skriva.sources import files, table_ranges


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def texts(seed, n):
    rnd = random.Random(seed)
    bits = ['"', '""', '"', ",", ";", "\t", "\n", "\r\n", "\r", " ", " ", "　", "a", "bc", "é", "漢字", "x y", "\n\n"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.choice([1, 5, 60, 400]))) for _ in range(n)]


@pytest.mark.parametrize("delimiter", [",", "\t"])
def test_maps_compose_as_the_whole(delimiter):
    for text in texts(1, 200):
        quoting = table_ranges.Quoting(delimiter)
        whole = quoting.map(text)
        for at in range(len(text) + 1):
            a, b = quoting.map(text[:at]), quoting.map(text[at:])
            assert tuple(b[s] for s in a) == whole


def test_random_quotes_and_splits(spark, tmp_path):
    for i, text in enumerate(texts(2, 40)):
        codec = ["utf-8", "utf-8-sig", "utf-16", "cp1252"][i % 4]
        data = text.encode(codec, "ignore")
        if codec == "utf-16" and i % 8 > 3:
            data = b"\xfe\xff" + text.encode("utf-16-be")
        (tmp_path / f"t{i:02}.csv").write_bytes(data)
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "blank.csv").write_bytes(b"\n \n,,\n")
    content = spark.createDataFrame([(str(p), bytearray(p.read_bytes())) for p in sorted(tmp_path.iterdir())], "path string, content binary")
    want = sorted((r.path, r.row_no, r.cells) for r in files.read_tables(content).collect())
    assert len(want) > 300
    for size in (7, 100, 10_000):
        got = sorted((r.path, r.row_no, r.cells) for r in table_ranges.read_tables(spark, str(tmp_path), size).collect())
        assert got == want, size


def test_a_row_longer_than_ranges(spark, tmp_path):
    field = "line, one\nline two ""\n" * 9000
    rows = [["a", "b"], ["1", field], ["2", "short"], ["", "3"]]
    quoted = "\r\n".join(",".join('"' + c.replace('"', '""') + '"' for c in r) for r in rows)
    (tmp_path / "long.csv").write_text(quoted, newline="")
    got = table_ranges.read_tables(spark, str(tmp_path), 5000)
    assert [r.cells for r in got.orderBy("row_no").collect()] == rows
