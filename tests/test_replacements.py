"""Rules as a table against the rules one after another."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from skriva.functions import text
from skriva.operators import replacements
from skriva.plans.registry import written

SCHEMA = "position int, find string, to string, whole_word boolean"


def rules_of(r, n, letters):
    word = lambda least: "".join(r.choice(letters) for _ in range(r.randint(least, 4)))
    return [(i, r.choice(["", " "]) + word(1) if i % 11 else " ", word(0), r.random() < 0.5) for i in range(n)]


@pytest.mark.parametrize("seed,most", [(1, 200_000), (2, 7), (3, 1)])
def test_as_one_rule_after_another(spark, monkeypatch, seed, most):
    """In one pass or many, with letters of all kinds; replacements that make, join and uncover matches of later rules."""
    monkeypatch.setattr(replacements, "MOST_RULES", most)
    r = random.Random(seed)
    letters = "abAB'é É’ß1.-𝒳"
    rules = rules_of(r, 16, letters)
    texts = [(i, "".join(r.choice(letters + "  ") for _ in range(r.randint(0, 120)))) for i in range(60)] + [(99, None), (98, ""), (97, "x" * 100_000 + " ab")]
    df = spark.createDataFrame(texts, "id int, text string")
    shuffled = rules[:]
    r.shuffle(shuffled)
    got = replacements.replaced(df, "text", spark.createDataFrame(shuffled, SCHEMA), written)
    said, made = text.replace("text", [text.Rule(f, t, w) for _, f, t, w in rules])
    want = df.select("id", said.alias("said"), F.coalesce(made, F.lit(0)).alias("made"))
    rows = {x.id: (x.said, x.made) for x in got.collect()}
    assert sum(m for _, m in rows.values()) > 100
    assert rows == {x.id: (x.said, x.made if x.said is not None else 0) for x in want.collect()}


def test_five_thousand_rules(spark):
    """As tried one by one; the plan is that of a few rules."""
    r = random.Random(5)
    rules = [(i, "".join(r.choice("abcd") for _ in range(r.randint(3, 7))), "".join(r.choice("abcd ") for _ in range(r.randint(0, 5))), r.random() < 0.3) for i in range(5000)]
    texts = [(i, "".join(r.choice("abcd   ") for _ in range(300))) for i in range(20)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = replacements.replaced(df, "text", spark.createDataFrame(rules, SCHEMA), written)

    def in_turn(t):
        made = 0
        for _, find, to, whole in rules:
            out, at = "", 0
            while at < len(t):
                end = at + len(find)
                free = not whole or not (at and t[at - 1].isalnum() or end < len(t) and t[end].isalnum())
                if t.startswith(find, at) and free:
                    out, at, made = out + to, end, made + 1
                else:
                    out, at = out + t[at], at + 1
            t = out
        return t, made

    assert {x.id: (x.said, x.made) for x in got.collect()} == {i: in_turn(t) for i, t in texts}
    size = lambda n: len(replacements.replaced(df, "text", spark.createDataFrame(rules[:n], SCHEMA), written)._jdf.queryExecution().toString())
    assert abs(size(3) - size(3000)) < 50


def test_no_rules_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    none = replacements.replaced(df, "text", spark.createDataFrame([], SCHEMA), written)
    assert [tuple(x) for x in none.orderBy("id").collect()] == [(1, "a b", "a b", 0), (2, None, None, 0)]
    removed = replacements.replaced(df, "text", spark.createDataFrame([(None, "A", None, None), (1, None, "x", True)], SCHEMA), written)
    assert [tuple(x) for x in removed.orderBy("id").collect()] == [(1, "a b", " b", 1), (2, None, None, 0)]
    with pytest.raises(ValueError, match="said"):
        replacements.replaced(none, "text", spark.createDataFrame([], SCHEMA), written)


@pytest.mark.parametrize("seed", range(4))
def test_words_for_themselves_are_as_rules_in_turn(seed, monkeypatch):
    """Rules of whole words build on each other, bring in several words or none, and are there twice; letters of all kinds."""
    r = random.Random(seed)
    monkeypatch.setattr(replacements, "WORDS", 3)
    letters = "abAB'éÉ’ß1𝒳İiΣσςǅ"
    word = lambda most, some=letters: "".join(r.choice(some) for _ in range(r.randint(1, most)))
    rules = [(word(2), word(3, letters + " - ") if r.random() < 0.8 else "", True) for _ in range(60)]
    by_word = replacements.Rules(rules)
    in_turn = replacements.Rules([*rules, ("none of it", "", True)])
    assert by_word.by_word and not in_turn.by_word
    texts = [" ".join(word(2) + r.choice(["", ".", "-"]) for _ in range(r.randint(0, 40))) for _ in range(100)]
    got = [by_word.apply(t) for t in texts]
    assert got == [in_turn.apply(t) for t in texts] and sum(n for _, n in got) > 100


@pytest.mark.parametrize("below", [0x80, 0x10000, 0x110000])
def test_a_word_is_the_same_run_of_letters(below):
    every = "".join(chr(c) for c in range(below) if not 0xD800 <= c < 0xE000)
    assert replacements.split(every) == regex.split(r"([\p{Alphabetic}\p{N}'’]+)", every)
