import random
import struct

import pytest
from pyspark.sql import functions as F

from skriva.operators import flows, sequences
from skriva.plans import capture_report, fixtures
from skriva.sources import archive, capture, files, office, packet, pdf


def frames(*flags):
    out = []
    for i, (f, back) in enumerate(flags):
        a, b, p, q = (b"\x0a\0\0\1", b"\x0a\0\0\2", 5000, 80)
        out.append((i * 10**9, packet.build(b, a, 6, q, p, f, None) if back else packet.build(a, b, 6, p, q, f, None)))
    return out


def rolled(spark, content):
    raw = capture.read_content(spark.createDataFrame([("x", bytearray(content))], "path string, content binary"))
    return raw, packet.decoded(raw)


@pytest.mark.parametrize(
    ("flags", "want"),
    [
        ([(2, False), (18, True), (16, False)], "It opened normally and was still open at the end."),
        ([(2, False), (20, True)], "The connection was refused."),
        ([(2, False), (2, False)], "The connection was never answered."),
        ([(2, False), (18, True), (17, False)], "It opened and closed normally."),
        ([(16, False)], "It was already under way when the capture started."),
    ],
)
def test_verdicts(spark, flags, want):
    _, got = rolled(spark, capture.write_classic(frames(*flags)))
    rows = flows.conversations(got).select("packets", flows.verdict().alias("v")).collect()
    assert [tuple(r) for r in rows] == [(len(flags), want)]


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", False), ("<", True), (">", True)])
def test_containers_agree(order, nano):
    import io

    rows = list(capture.packets("x", io.BytesIO(capture.write_classic(frames((2, False), (18, True)), order=order, nano=nano))))
    assert [r[2] for r in rows[:-1]] == [0, 10**9] and rows[-1][6:] == (False, False, None)


def block_file(order="<"):
    block = lambda kind, body: struct.pack(f"{order}II", kind, 12 + len(body)) + body + struct.pack(f"{order}I", 12 + len(body))
    data = packet.build(b"\x0a\0\0\1", b"\x0a\0\0\2", 17, 9, 53, 0, "Example.com")
    data += b"\0" * (-len(data) % 4)
    n = len(data)
    section = block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1))
    face = block(1, struct.pack(f"{order}HHIHHB3xHH", 1, 0, 0, 9, 1, 9, 0, 0))
    return section + face + block(99, b"skip") + block(6, struct.pack(f"{order}IIIII", 0, 0, 1500, n, n) + data) + block(3, struct.pack(f"{order}I", n) + data)


@pytest.mark.parametrize("order", ["<", ">"])
def test_block_format(order):
    import io

    rows = list(capture.packets("x", io.BytesIO(block_file(order))))
    assert [r[2] for r in rows[:-1]] == [1500, None] and rows[-1][8] is None
    assert packet.decode(rows[0][3], rows[0][4])[-1] == "Example.com"


def test_damage_never_raises():
    import io

    rnd = random.Random(5)
    for whole in (capture.write_classic(frames((2, False), (18, True))), block_file()):
        for n in range(len(whole)):
            rows = list(capture.packets("x", io.BytesIO(whole[:n])))
            assert rows[-1][1] is None
        for _ in range(600):
            broken = bytearray(whole)
            for _ in range(rnd.randint(1, 8)):
                broken[rnd.randrange(len(broken))] = rnd.randrange(256)
            for r in capture.packets("x", io.BytesIO(bytes(broken))):
                if r[4] is not None:
                    packet.decode(r[3], r[4])
    for link in (0, 1, 101, 113, 228, 229, 276, 77):
        for _ in range(300):
            packet.decode(link, bytes(rnd.randrange(256) for _ in range(rnd.randrange(90))))


def test_decoder_corners():
    frame = packet.build(b"\x0a\0\0\1", b"\x0a\0\0\2", 6, 1, 2, 2, None)
    tagged = frame[:12] + b"\x81\0\0\5\x88\xa8\0\1" + frame[12:]
    assert packet.decode(1, tagged) == packet.decode(1, frame)
    later = bytearray(frame)
    later[20:22] = b"\0\5"
    assert packet.decode(1, bytes(later))[7:9] == (None, None)
    v6 = b"\x60\0\0\0\0\x0c\0\x40" + bytes(15) + b"\1" + bytes(15) + b"\2" + b"\x06\0" + bytes(6) + frame[34:]
    assert packet.decode(101, v6)[:3] == ("ip", "::1", "::2") and packet.decode(101, v6)[7:9] == (1, 2)
    assert packet.decode(1, frame[:12] + b"\x08\x06")[0] == "arp" and packet.decode(1, b"") is None
    assert packet.question(struct.pack(">6H", 1, 0x8100, 1, 0, 0, 0) + b"\1a\0") is None


def test_report(spark):
    raw, got = rolled(spark, capture.write_classic(frames((2, False), (20, True))))
    text = capture_report.report(got, raw.filter("seq is null").select("file", "truncated", "capped")).first().text
    assert text.splitlines()[:3] == ["What the capture holds.", "2 packets in total, 108 bytes of traffic.", "It runs for 1 second."]
    assert "10 dot 0 dot 0 dot 1 port 5000 and 10 dot 0 dot 0 dot 2 port 80, TCP, HTTP: 2 packets, 108 bytes, 100 percent of the capture, from the start of the capture and lasting 1 second. The connection was refused." in text
    assert text.endswith("What went wrong.\n1 connection was refused outright.")


@pytest.mark.parametrize(
    ("text", "d", "want"),
    [
        ('a,b\r\n1,"x, ""y""\nz" w\r\n', ",", [["a", "b"], ["1", 'x, "y"\nz w']]),
        ("a;b;\n ; ;\n1", ";", [["a", "b", ""], ["1"]]),
        ('a\t "q"\rb\t5" x', "\t", [["a", "q"], ["b", '5" x']]),
        ('a,"open\nto the end', ",", [["a", "open\nto the end"]]),
        ("", ",", []),
    ],
)
def test_delimited(text, d, want):
    assert list(files.rows_of(text, d)) == want


def test_tables(spark):
    content = "h_1,\ufeff,b\n1,,x.,\n2\n".encode()
    df = spark.createDataFrame([("t", bytearray(content))], "path string, content binary")
    assert files.speak_tables(files.read_tables(df)).first().text == "Table with 2 rows and 3 columns.\n\nRow 1. h 1: 1. \ufeff: empty. b: x.\nRow 2. h 1: 2."
    only = spark.createDataFrame([("t", bytearray(b"a_b,c"))], "path string, content binary")
    assert files.speak_tables(files.read_tables(only)).first().text == "Table with no rows and 2 columns.\n\nThe columns are: a b, c."
    picked = spark.createDataFrame([("a,b;c",), ("\n x",), ("a;b;,\t,\t",)], "x string").select(files.delimiter_of(F.col("x"))).collect()
    assert [r[0] for r in picked] == [";", "\t", "\t"]


@pytest.mark.parametrize(("data", "want"), [(b"\xff\xfeA\0B\0C", "AB"), (b"\xfe\xff\0A", "A"), (b"\xef\xbb\xbfx", "x"), ("é".encode(), "é"), (b"\x80\x93\xe9\x81", "€“é\x81"), (b"", "")])
def test_decode(spark, data, want):
    assert spark.createDataFrame([(bytearray(data),)], "content binary").select(files.decode("content")).first()[0] == want


def test_word_formats():
    run = lambda p, t: f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    body = f"<w:p>{run('', 'A ')}{run('<w:b/>', 'bold')}{run('<w:b/><w:i/>', ' both')}{run('<w:b w:val=%s0%s/>' % (chr(34), chr(34)), '. End')}</w:p>"
    assert office.word_text(fixtures.word_file("", body), True).strip() == "A, bold, bold, italic, both, end italic, end bold. End"
    assert office.word_text(fixtures.word_file("", body)).strip() == "A bold both. End"
    assert office.colour_word("FE0101") == "red" and office.colour_word("000000") is None and office.colour_word("é00000") is None


def test_bad_files_are_rows(spark):
    df = spark.createDataFrame([("x", bytearray(b"nonsense")), ("y", None)], "path string, content binary")
    assert office.read_word(df).filter("error is not null").count() == 2
    assert office.read_slides(df).filter("error is not null").count() == 2
    assert pdf.read_pages(df).filter("error is not null").count() == 2
    assert archive.read_entries(df).filter("error is not null").count() == 2
    assert files.read_wav(df).filter("error is not null").count() == 2


def test_pdf_layers():
    assert pdf.ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!" and pdf.run_length(b"\2abc\xfex\x80") == b"abcxxx"
    assert pdf.lzw(b"\x80\x0b\x60\x50\x22\x0c\x0c\x85\x01") == b"-----A---B"
    assert pdf.Lexer(b"(a\\(b\\)\\101(c))").value() == b"a(b)A(c)" and pdf.Lexer(b"/A#42").value() == "AB" and pdf.Lexer(b"<4>").value() == b"@"
    assert pdf.cmap(b"1 beginbfrange <01> <03> <0041> endbfrange 1 beginbfchar <05> <00660069> endbfchar") == {b"\1": "A", b"\2": "B", b"\3": "C", b"\5": "fi"}
    assert [r[2] for r in pdf.pages_of("x", fixtures.pdf_file(["one two\nthree", "four"]))] == ["one two\nthree", "four"]
    rnd, whole = random.Random(9), fixtures.pdf_file(["some text"], False)
    for _ in range(200):
        broken = bytearray(whole)
        for _ in range(6):
            broken[rnd.randrange(len(broken))] = rnd.randrange(256)
        list(pdf.pages_of("x", bytes(broken)))


@pytest.mark.parametrize(("kept", "dropped", "want"), [(4381, 3, False), (3661, 39, False), (1225, 518, True), (0, 1593, True), (0, 4, False)])
def test_garbled(spark, kept, dropped, want):
    assert spark.range(1).select(sequences.garbled(F.lit(kept), F.lit(dropped))).first()[0] is want


def test_pages(spark):
    rows = [("p", 1, "a", False), ("p", 2, "", True), ("p", 3, "x", True), ("p", 4, "b", False), ("p", 5, "", True)]
    df = spark.createDataFrame(rows, "path string, page_no int, text string, garbled boolean")
    text = sequences.assemble_pages(df).first().text
    assert text.split("\n\n") == ["a", "[Pages 2 to 3 could not be read: the fonts used there do not say what their letters are.]", "x", "b", "[Page 5 could not be read: the fonts used there do not say what their letters are.]"]
    assert sequences.ranges(df.filter("garbled"), "path", "page_no").first().said == "pages 2 and 3, 5"


def test_archive(spark):
    data = fixtures.zipped({"b/2.mp3": "x", "b/10.mp3": "x", "__MACOSX/a.mp3": "x", "../e.mp3": "x", "n.txt": "x", "._a.mp3": "x", "b/1.MP3": "x"})
    entries = archive.read_entries(spark.createDataFrame([("z", bytearray(data))], "path string, content binary"))
    have = sequences.playable_entries(entries)
    listed = archive.read_manifests(spark.createDataFrame([("z", "# c\n10.MP3\nlost.mp3\n")], "path string, text string"))
    tracks, missing = sequences.arrange(have, listed)
    assert [r.path for r in tracks.orderBy("track_no").collect()] == ["b/10.mp3", "b/1.MP3", "b/2.mp3"] and [r.name for r in missing.collect()] == ["lost.mp3"]
    assert list(archive.manifest('<x><audio type="music" pos="2">a.mp3</audio><audio>b.mp3</audio></x>')) == [("a.mp3", "music", 2), ("b.mp3", None, None)]


def test_wav():
    assert files.wav_samples(files.write_wav(1, 8000, [1, -2])) == (1, 8000, [1, -2])


#: What each of Word's pens is called (the values are fixed and stand here in full).
PENS = "yellow yellow, green bright green, cyan turquoise, magenta pink, blue blue, red red, darkBlue dark blue, darkCyan teal, darkGreen green, darkMagenta violet, darkRed dark red, darkYellow dark yellow, darkGray grey, lightGray light grey, black black, white white"


@pytest.mark.parametrize("pen", PENS.split(", "))
def test_highlights(pen):
    name, _, said = pen.partition(" ")
    data = fixtures.formatted_file([[("a ", ""), ("b", f'<w:highlight w:val=" {name} "/>')]])
    assert office.word_text(data, formats=True).strip() == f"a, highlighted {said}, b, end highlighted {said}"


def test_captures_reach_python_in_bounded_batches(spark):
    """Ten thousand capture files of any size would be one batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        capture.read_content(spark.createDataFrame([("a", b"")], "path string, content binary"))
        assert int(spark.conf.get(name)) <= 4 << 20
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _archives(folder):
    """Archives as Python's own module and as the writer makes them, whole and broken."""
    import io
    import zipfile

    def made(names, comment=b"", before=b""):
        out = io.BytesIO(before)
        out.seek(0, 2)
        with zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z:
            z.comment = comment
            for n in names:
                z.writestr(n, "said " * (len(n) % 40))
        return out.getvalue()

    yield from (made(["a.mp3", "b/ü.wav", "x" * 60_000, "b/ü.wav"]), made(["a"], b"a comment", b"prefix"), made([]), made(["é", "k"], b"PK\5\6"))
    yield made([f"{i}.mp3" for i in range(70_000)])
    out = archive.Writer(f"{folder}/own")
    for i in range(66_000):
        out.add(f"{i} – é.mp3" if i % 2 else str(i), b"say " * (i % 50))
    out.close()
    own = open(f"{folder}/own", "rb").read()
    assert zipfile.ZipFile(io.BytesIO(own)).read("47 – é.mp3") == b"say " * 47 and zipfile.ZipFile(io.BytesIO(own)).testzip() is None
    yield own
    whole = made(["a.mp3", "b.mp3"])
    wide = bytearray(whole)
    at = wide.rfind(b"PK\1\2")
    wide[at + 24 : at + 28] = b"\xff" * 4
    yield from (whole[:-30], whole[10:], b"", b"PK\5\6", whole[: whole.rfind(b"PK\1\2")] + b"no" + whole[whole.rfind(b"PK\1\2") + 2 :], bytes(wide))


def test_entries_are_those_of_pythons_own_reader(tmp_path):
    import io
    import zipfile

    faults = 0
    for data in _archives(tmp_path):
        try:
            want = [(e.filename, e.file_size) for e in zipfile.ZipFile(io.BytesIO(data)).infolist()]
        except zipfile.BadZipFile:
            with pytest.raises(zipfile.BadZipFile):
                list(archive.listed(io.BytesIO(data)))
            faults += 1
        else:
            got = list(archive.listed(io.BytesIO(data)))
            assert got == want or data[-200:].count(b"\xff" * 4) and [g[0] for g in got] == [w[0] for w in want]
    assert faults >= 4


def test_large_archives_are_not_held(tmp_path):
    """The peak of writing and reading 60,000 entries stays that of a few."""
    import tracemalloc

    tracemalloc.start()
    out = archive.Writer(f"{tmp_path}/large")
    for i in range(60_000):
        out.add(f"Disc/a track of some length {i}.mp3", b"x")
    out.close()
    with open(f"{tmp_path}/large", "rb") as f:
        assert sum(1 for _ in archive.listed(f)) == 60_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20


def test_archives_from_rows_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(None if k % 3 == 0 else f"a/{k % 3}", 50 - k) for k in range(50)], "path string, k long").repartition(5)
    made = archive.write_archives(rows, ["k"], lambda r: [(f"{r['k']}.mp3", b"x" * r["k"])], f"{tmp_path}/out")
    got = archive.read_entries(made).collect()
    assert sorted((r.archive or "", r.entry_index, r.path, r.size) for r in got) == sorted((p or "", i, f"{k}.mp3", k) for p in (None, "a/1", "a/2") for i, k in enumerate(sorted(50 - k for k in range(50) if (None if k % 3 == 0 else f"a/{k % 3}") == p)))
