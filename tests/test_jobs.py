import random
import struct

import pytest
from pyspark.sql import functions as F

from skriva.functions import jobs, messages, text
from skriva.sources import files, media


def test_decisions(spark):
    lit = F.lit
    row = spark.range(1).select(
        jobs.engine(lit("elevenlabs"), lit(True), lit("pcap"), lit(False), lit(True)), jobs.engine(lit("elevenlabs"), lit(False), lit("text"), lit(False), lit(True)),
        jobs.current_model(lit("Llama3.2-Vision:11b")), jobs.current_model(lit("x:1")), jobs.is_voice_id(lit("a-B_1")), jobs.is_voice_id(lit("a/b")),
        jobs.download_url(F.array(lit("http://a"), lit("https://b")), "p"), jobs.system_language(lit("C.UTF-8"), lit("fr_FR.UTF-8")), jobs.samples(F.array(lit(2.0), lit(-0.5))),
        jobs.voice_detail(lit(""), lit("well_spoken"), lit("c")), files.failure(lit("it requires more system memory")), files.kind_of(lit("/a/B.MARKDOWN")), files.refusal(lit("x.ppt")).isNotNull(),
        files.frame_time(lit("n:1 pts_time: 2.5 x")), files.frame_time(lit("pts_time:inf")),
    ).first()
    assert tuple(row) == ("system", "missing key", "qwen2.5vl:3b", "x:1", True, False, "https://b", "fr-FR", [32767, -16383], "well spoken", "memory", "text", True, 2.5, None)


def test_unique_names(spark):
    df = spark.createDataFrame([(1, "a.wav"), (2, "a.wav"), (3, "b"), (4, "b")], "i int, name string")
    assert [r.unique for r in jobs.unique_names(df, "name", "i").orderBy("i").collect()] == ["a.wav", "a (2).wav", "b", "b (2)"]


@pytest.mark.parametrize("seed", range(4))
def test_unique_names_are_unique(spark, seed):
    rnd = random.Random(seed)
    names = [rnd.choice(["a", "b.x"]) + "".join(rnd.choice(["", " (2)", f" ({rnd.randrange(1, 9)})"]) for _ in range(2)) + rnd.choice(["", ".mp3"]) for _ in range(150)] + ["a (2)", "a (02)", "n\nm", "n\nm", " (2)", "", "", ".mp3", ".mp3", " (2).mp3", "a.b", "a.b", "a.b (2)"]
    old = {"a.mp3", "a (4).mp3", "b.x (2)"} if seed % 2 else set()
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r.unique for r in jobs.unique_names(df, "name", "i", spark.createDataFrame([(x,) for x in old], "name string") if old else None).orderBy("i").collect()]
    assert len(set(got)) == len(names) and not set(got) & old
    given, want = set(), []
    for name in names:
        if name not in given | old:
            want.append(name)
        else:
            stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
            want.append(next(x for n in range(2, 999) if (x := f"{stem} ({n}){dot}{ext}") not in given | old | set(names)))
        given.add(want[-1])
    assert got == want


def test_refused_files_are_rows(spark):
    files_ = spark.createDataFrame([("a.csv", bytearray(b"h\n1")), ("b.csv", None)], "path string, content binary")
    assert sorted((r.path, r.cells, r.error) for r in files.read_tables(files_).collect()) == [("a.csv", ["1"], None), ("a.csv", ["h"], None), ("b.csv", None, "cannot be read")]
    assert [r.path for r in files.speak_tables(files.read_tables(files_)).collect()] == ["a.csv"]
    twice = spark.createDataFrame([("p", bytearray(b"x")), ("p", bytearray(b"y")), ("q", None)], "path string, content binary")
    assert sorted((r.path, r.payload or "", r.error) for r in media.read_images(twice).collect()) == [("p", "eA==", None), ("p", "eQ==", None), ("q", "", "cannot be read")]


def test_values_are_not_read_as_slots(spark):
    rows = [("{a}-{b}", "{b} {{x", "B", "{b} {{x-B"), ("{{a}} {c} }}{a", "1", "2", "{a} {c} }1"), ("", "1", "2", ""), ("{a{b}", "1", "2", "{a{b}"), ("{b}{b}", "1", "$0\\", "$0\\$0\\"), (None, "1", "2", None)]
    df = spark.createDataFrame(rows, "t string, a string, b string, want string")
    got = df.select("want", messages.filled(F.col("t"), F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]



def picture(orientation=6):
    gps = struct.pack("<H", 4) + b"".join(struct.pack("<HHI4s", *e) for e in ((1, 2, 2, b"S\0\0\0"), (2, 5, 3, struct.pack("<I", 120)), (3, 2, 2, b"E\0\0\0"), (4, 5, 3, struct.pack("<I", 144)))) + bytes(4)
    first = struct.pack("<H", 2) + struct.pack("<HHIHH", 0x112, 3, 1, orientation, 0) + struct.pack("<HHII", 0x8825, 4, 1, 38) + bytes(4)
    tiff = b"II*\0" + struct.pack("<I", 8) + first + gps
    tiff += bytes(120 - len(tiff)) + struct.pack("<6I", 10, 1, 30, 1, 0, 1) + struct.pack("<6I", 20, 1, 0, 1, 36, 1)
    exif = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 3000, 4096, 3) + bytes(10)


def test_pictures(spark):
    df = spark.createDataFrame([("a.jpg", bytearray(picture())), ("b.png", bytearray(b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 10, 20))), ("c", bytearray(b"\xff\xd8\xff"))], "path string, content binary")
    got = {r.path: r for r in media.read_images(df).collect()}
    a = got["a.jpg"]
    assert (a.width, a.height, a.turn, a.anew, tuple(a.send)) == (4096, 3000, "quarter turn right", True, (2048, 1500)) and abs(a.lat + 10.5) < 1e-9 and abs(a.lon - 20.01) < 1e-9
    assert tuple(got["b.png"].send) == (10, 20) and not got["b.png"].anew and got["c"].width is None


def test_described(spark):
    df = spark.createDataFrame([("v", 0.2, bytearray(b"x")), ("v", 61.0, bytearray(b""))], "path string, t double, payload binary")
    said = media.described(df, lambda batch: [f" {len(x)} bytes " for x in batch])
    assert media.video_transcript(said).first().text == "At the start: 1 bytes\n\n1 minute 1 second in: 0 bytes"


def test_voices_keys_and_settings(spark):
    lit, voices = F.lit, F.array(F.lit("a"), F.lit("b"))
    none = F.expr("cast(array() as array<string>)")
    got = jobs.settings(lit('{"x": 3, "z": 1}'), {"x": "1", "y": "2"})
    row = spark.range(1).select(jobs.kept_voice(lit("b"), voices), jobs.kept_voice(lit("c"), voices), jobs.kept_voice(lit("c"), none), jobs.api_key(lit(" \n"), lit(" s ")), jobs.api_key(lit("e"), lit("s")), jobs.api_key(lit(None), lit("")), got, jobs.settings(lit("no"), {"x": "1"})).first()
    assert tuple(row) == ("b", "a", "c", "s", "e", None, {"x": "3", "y": "2"}, {"x": "1"})


def test_untouched(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "prompt string")
    got = jobs.is_untouched(df("", "  ", " Say it.\n", "Say it", "own"), df("Say it.", "Sag es."))
    assert sorted(r.prompt for r in got.collect()) == ["", "  ", " Say it.\n"]


def test_speech_and_notes(spark, tmp_path):
    said, made = jobs.speech(F.lit("A quay."), F.lit("Read by ElevenLabs."), [text.Rule("ElevenLabs", "Eleven Labs")])
    assert tuple(spark.range(1).select(said, made).first()) == ("A quay.\n\nRead by Eleven Labs.", 1)
    assert spark.range(1).select(jobs.speech(F.lit("A."), F.lit(None).cast("string"), [])[0]).first()[0] == "A."
    df = spark.createDataFrame([("/x/a.pdf", "abc", "page 2 could not be read"), ("b.txt", "", None)], "path string, text string, caveat string")
    jobs.write_extracted(df, str(tmp_path / "out"))
    assert {r.path: (r.text, r.note) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"/x/a.pdf": ("abc", "a.pdf: 3 characters · page 2 could not be read"), "b.txt": ("", "b.txt: 0 characters")}
