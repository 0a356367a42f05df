import random
import re

import pytest
from pyspark.sql import functions as F

from skriva.functions import messages, spoken, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [("a  \n\n\n\nb\t", "a\n\nb"), ("\u3000x\xa0\n y ", "x\n y"), ("", ""), ("\n\n", ""), ("a\r\nb", "a\nb"), (None, None)],
)
def test_tidy(spark, given, want):
    assert one(spark, given, text.tidy) == want


@pytest.mark.parametrize(
    ("rules", "given", "want", "n"),
    [
        ([text.Rule("cat", "dog")], "Cat cats cat's CAT (cat)", "Dog cats cat's Dog (dog)", 3),
        ([text.Rule("cat", "dog", False)], "concat", "condog", 1),
        ([text.Rule("a", "b"), text.Rule("b", "c")], "a b", "c c", 3),
        ([text.Rule("  ", "x"), text.Rule("x.y", "")], "x.y xzy", " xzy", 1),
        ([text.Rule("été", "hiver")], "Été été", "Hiver hiver", 2),
    ],
)
def test_replace(spark, rules, given, want, n):
    said, made = text.replace("x", rules)
    assert tuple(spark.createDataFrame([(given,)], "x string").select(said, made).first()) == (want, n)


def test_units_lose_nothing(spark):
    given = 'One. Two!  "Three?" four.five\nsix 。 end'
    found = one(spark, given, text.units)
    assert "".join(found) == given and found[:2] == ["One. ", "Two!  "]


@pytest.mark.parametrize("most", [5, 12, 40])
def test_chunks(spark, most):
    given = "First sentence. Second one is here! averyverylongwordthatmustbecut end."
    found = one(spark, given, lambda c: text.chunks(c, most))
    assert all(0 < len(c) <= most for c in found)
    assert "".join("".join(found).split()) == "".join(given.split())


def packed(given, most):
    """Chunks as a loop: units, then words of a unit that is too long, then pieces of a word that is."""
    out, now = [], ""

    def close():
        nonlocal now
        out.extend([now.strip()] if now.strip() else [])
        now = ""

    def add(part):
        nonlocal now
        if len(now) + len(part) > most:
            close()
        now += part

    for unit in re.findall(r"""(?s).*?(?:[.!?。！？\n](?=[\s"']|\Z)\s*|\Z)""", given):
        if len(unit) <= most:
            add(unit)
            continue
        close()
        for word in re.findall(r"\S*\s|\S+\Z", unit):
            for i in range(0, len(word), most):
                add(word[i : i + most])
        close()
    close()
    return out


@pytest.mark.parametrize("most", [1, 3, 7, 20, 64])
def test_chunks_are_those_of_a_loop(spark, most):
    rnd = random.Random(most)
    bits = ["a", "bb", "ccc", "longerword", "x" * 70, " ", "  ", "\n", ". ", "! ", "。", "\u3000", "é", '"', "12.5"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select(text.chunks("x", most)).collect()
    assert [r[0] for r in got] == [packed(t, most) for t in texts]


def test_neighbours(spark):
    found = spark.createDataFrame([(["ab", "cd", "e"],)], "x array<string>").select(text.with_neighbours("x", 1)).first()[0]
    assert [tuple(x) for x in found] == [(0, "ab", None, "c"), (1, "cd", "b", "e"), (2, "e", "d", None)]


def test_many_rules_are_one_expression_each(spark):
    """Ten rules over a long text: the expression grows in proportion to the rules."""
    rules = [text.Rule(f"w{i}", f"w{i + 1}") for i in range(10)]
    said, made = text.replace("x", rules)
    df = spark.createDataFrame([("W0 w5 other " * 5000,)], "x string").select(said.alias("said"), made.alias("made"))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 40_000
    row = df.first()
    assert row.made == 5000 * 15 and row.said == "W10 w10 other " * 5000


def test_redact(spark):
    assert one(spark, "a sk_12345678 b sk_123 c", text.redact) == "a [redacted 11 characters] b sk_123 c"
    assert one(spark, "is topsecretvalue", lambda c: text.redact(c, F.lit("topsecretvalue"))) == "is [redacted 14 characters]"


def test_natural_order(spark):
    names = ["b10", "b9", "B2", "10", "9", "b99999999999999999999999", "b", "a1x", "a1"]
    got = [r.x for r in spark.createDataFrame([(n,) for n in names], "x string").orderBy(text.natural_key("x")).collect()]
    assert got == ["9", "10", "a1", "a1x", "b", "B2", "b9", "b10", "b99999999999999999999999"]


@pytest.mark.parametrize(("n", "want"), [(0, "no bytes"), (1, "1 byte"), (1023, "1023 bytes"), (1536, "2 kilobytes"), (2560, "2 kilobytes"), (1 << 20, "1.0 megabytes"), ((1 << 30) * 5 // 4, "1.2 gigabytes")])
def test_spoken_bytes(spark, n, want):
    assert spark.createDataFrame([(n,)], "n long").select(spoken.spoken_bytes("n")).first()[0] == want


def test_spoken(spark):
    row = spark.createDataFrame([(61.9, "fe80::1", "2.0.0-rc1")], "t double, a string, v string")
    got = row.select(spoken.spoken_time(F.col("t")), spoken.moment(F.lit(0.5)), spoken.spoken_address(F.col("a")), spoken.is_newer(F.lit("2.0.0"), F.col("v")), spoken.is_newer(F.lit("x"), F.col("v")))
    assert tuple(got.first()) == ("1 minute 1 second", "At the start", "fe80 double colon 1", True, False)


def test_language_file():
    text_ = 'code = "xx"\na.b = "one"\n  "two\\n" # note\n\n"lost"\nbad\nA = "x"\nc = x\nd = "x\na.b = "again"\n'
    got = list(messages.parse(text_))
    assert ("a.b", "again", 10, None) in got and ("code", "xx", 1, None) in got
    assert sorted(line for _, _, line, what in got if what) == [5, 6, 7, 8, 9, 10]


def test_fill(spark):
    row = spark.range(1).select(messages.filled(F.lit("{a} {{a}} {b} {a"), F.create_map(F.lit("a"), F.lit("1"))).alias("said"))
    assert row.head().said == "1 {a} {b} 1"


def test_replacing_scans_a_text_three_times_a_rule(spark):
    """Whether there is a match, the matches and what is between them; letters are looked for before what precedes them."""
    rule = text.Rule("the", "a")
    said, made = text.replace("t", [rule])
    df = spark.createDataFrame([("The 'the the. breathe THE",), (None,), ("none",)], "t string")
    out = df.select(said.alias("said"), made.alias("made"))
    assert [tuple(x) for x in out.collect()] == [("A 'the a. breathe A", 3), (None, 0), ("none", 0)]
    assert said._jc.toString().count("(?=the)") == 3


def test_units_and_hard_chunks_as_in_python(spark):
    """Random texts of ends, quotes, white space and letters of two code units, at sizes that cut words; a unit that is too long is cut at once."""
    r = random.Random(8)
    texts = ["".join(r.choice("ab.!\n 　\"'。𝒳\u2028") for _ in range(r.randint(0, 200))) for _ in range(300)] + ["x" * 9000, "a b " * 9000, ". " * 9000, "a\n" * 9000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", text.units("t").alias("u"), *[text.chunks("t", n).alias(f"c{n}") for n in (1, 7, 30)]).collect()
    white = r"[\s\x85]"
    for x in got:
        units = [u for u in re.findall(rf"""(?s).*?(?:[.!?。！？\n](?=[\s"']|\Z){white}*|\Z)""", texts[x.i]) if u]
        assert x.u == units
        for n in (1, 7, 30):
            assert x[f"c{n}"] == text.pack(units, n)
    assert "sequence(" not in text.chunks("t", 7)._jc.toString()
