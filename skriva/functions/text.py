"""Text functions, Column to Column, without Python workers unless named otherwise.

White space is any Unicode white space; lengths count code points. Nulls give null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of a sentence for cells, for slide lines and for speech units (fixed values).
CELL_ENDS, LINE_ENDS, UNIT_ENDS = ".!?", ".!?:;,", ".!?。！？\n"
#: Chunk and neighbour sizes, in characters, and the shortest secret worth hiding (fixed values).
CHUNK, NEIGHBOUR, SECRET = 4500, 300, 12
WORD_CHARS = r"[\p{IsAlphabetic}\p{N}'’]"
#: The same to look behind for: Java steps back by code units, and a letter may be two of them.
WORD_BEFORE = WORD_CHARS + "{1,2}"
_TRIM = r"(?U)\A\s+|\s+\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), _TRIM, "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space to one space, trimmed."""
    return trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def tidy(c: Column | str) -> Column:
    """Lines without trailing white space, at most one blank line in a row, trimmed."""
    c = F.regexp_replace(_col(c), r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    return trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


@dataclass(frozen=True)
class Rule:
    """A replacement; unusable if find is blank."""

    find: str
    to: str
    whole_word: bool = True

    @property
    def usable(self) -> bool:
        return bool(self.find.strip())

    @property
    def pattern(self) -> str:
        quoted = "".join(c if c.isalnum() else "\\" + c if ord(c) < 128 else c for c in self.find.strip())
        # the letters first: to look behind costs more, and they are at few places
        return f"(?iu)(?={quoted})(?<!{WORD_BEFORE}){quoted}(?!{WORD_CHARS})" if self.whole_word else f"(?iu){quoted}"


def _bound(value: Column, body) -> Column:
    """body(value), where value is evaluated once however often body names it: a projection would be merged away."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace(c: Column | str, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, replacements made): the rules in turn, each over the result of those before.

    A match that begins with a capital gives a replacement that does; nothing else of its case is kept.
    Each rule binds the text before it, so the work is linear in the text and in the rules.
    """
    state = F.struct(_col(c).alias("text"), F.lit(0).cast("long").alias("made"))
    for rule in (r for r in rules if r.usable):
        state = _bound(state, lambda s: _replaced(s, rule))  # noqa: B023
    return state["text"], state["made"]


def _replaced(state: Column, rule: Rule) -> Column:
    big = rule.to[:1].upper() + rule.to[1:]
    new = lambda m: F.when(m.rlike(r"\A\P{IsAlphabetic}*+\p{Lu}"), F.lit(big)).otherwise(F.lit(rule.to))
    cut = F.struct(F.regexp_extract_all(state["text"], F.lit(rule.pattern), F.lit(0)).alias("found"), F.split(state["text"], rule.pattern, -1).alias("parts"), state["made"].alias("made"))
    text = lambda x: F.concat(F.get(x["parts"], F.lit(0)), F.array_join(F.zip_with(x["found"], F.slice(x["parts"], 2, F.greatest(F.size(x["found"]), F.lit(0))), lambda m, p: F.concat(new(m), p)), ""))
    some = _bound(cut, lambda x: F.struct(text(x).alias("text"), (x["made"] + F.size(x["found"])).alias("made")))
    return F.when(F.regexp_like(state["text"], F.lit(rule.pattern)), some).otherwise(state)


def units(c: Column | str) -> Column:
    """Speech units: cut after an end if white space, a quote or nothing follows; that white space stays on the unit."""
    found = F.regexp_extract_all(_col(c), F.lit(r"""(?Us).*?(?:[.!?。！？\n](?=[\s"']|\z)\s*|\z)"""), F.lit(0))
    return F.filter(found, lambda u: u != "")


def split_hard(text: str, most: int) -> list[str]:
    """A unit that is too long, packed word by word (each with the white space after it); a longer word is cut."""
    out, now = [], ""
    for word in re.findall(r"\S*\s|\S+\Z", text) or ([text] if text else []):
        if len(now) + len(word) > most and now:
            out += [now.strip()] if now.strip() else []
            now = ""
        while len(word) > most:
            out.append(word[:most])
            word = word[most:]
        now += word
    if now.strip():
        out.append(now.strip())
    return out


def pack(found: list[str], most: int) -> list[str]:
    """Units packed greedily to at most so many characters; chunks are trimmed and not empty."""
    out, now = [], ""
    for unit in found:
        if len(unit) > most:
            if now.strip():
                out.append(now.strip())
            now = ""
            out += split_hard(unit, most)
            continue
        if len(now) + len(unit) > most:
            if now.strip():
                out.append(now.strip())
            now = ""
        now += unit
    if now.strip():
        out.append(now.strip())
    return out


def chunks(c: Column | str, most: int = CHUNK) -> Column:
    """Chunks of at most `most` characters, on unit bounds where those allow; a longer unit has chunks of its own.

    A fold over units. One that is too long is cut first, by one expression: as many characters as fit that end with
    white space or the unit, else that many of a word; no two of these fit in a chunk. A null before and after
    them closes the chunk. No Python.
    """
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("now"))
    size = F.lit(most)
    hard = lambda u: F.regexp_extract_all(u, F.lit(rf"(?Us).{{1,{most}}}(?:(?<=\s)|\z)|.{{{most}}}"), F.lit(0))
    none = F.array(F.lit(None).cast("string"))
    items = F.flatten(F.transform(units(c), lambda u: F.when(F.length(u) <= size, F.array(u)).otherwise(F.concat(none, hard(u), none))))

    def close(acc):
        return _bound(F.regexp_extract(acc["now"], r"(?Us)\S(?:.*\S)?", 0), lambda t: F.when(t != "", F.concat(acc["out"], F.array(t))).otherwise(acc["out"]))

    def step(acc, u):
        fits = F.length(acc["now"]) + F.length(u) <= size
        return F.when(fits, F.struct(acc["out"].alias("out"), F.concat(acc["now"], u).alias("now"))).otherwise(F.struct(close(acc).alias("out"), F.coalesce(u, F.lit("")).alias("now")))

    return F.aggregate(items, start, step, close)


def with_neighbours(parts: Column | str, most: int = NEIGHBOUR) -> Column:
    """Each chunk with the last characters of the one before and the first of the one after, null at the ends."""

    def each(all_: Column) -> Column:
        before, after = (lambda i: F.get(all_, i - 1)), (lambda i: F.get(all_, i + 1))
        return F.transform(all_, lambda p, i: F.struct(i.alias("chunk_no"), p.alias("chunk"), F.when(i > 0, F.right(before(i), F.lit(most))).alias("prev"), F.left(after(i), F.lit(most)).alias("next")))

    return _bound(_col(parts), each)


def redact(c: Column | str, known: Column | None = None) -> Column:
    """Hides a known secret, then whatever looks like a key; the mark tells how long it was."""
    text = _col(c)
    mark = lambda secret: F.concat(F.lit("[redacted "), F.length(secret).cast("string"), F.lit(" characters]"))
    if known is not None:
        text = F.when(F.length(known) >= SECRET, F.replace(text, known, mark(known))).otherwise(text)
    key = r"sk_[A-Za-z0-9_-]{8,}"

    def hidden(t: Column) -> Column:
        found, parts = F.regexp_extract_all(t, F.lit(key), F.lit(0)), F.split(t, key, -1)
        cut = F.struct(found.alias("found"), parts.alias("parts"))
        return _bound(cut, lambda x: F.concat(F.get(x["parts"], F.lit(0)), F.array_join(F.zip_with(x["found"], F.slice(x["parts"], 2, F.size(x["found"])), lambda m, p: F.concat(mark(m), p)), "")))

    return _bound(text, lambda t: F.when(F.regexp_like(t, F.lit(key)), hidden(t)).otherwise(t))


def heading(c: Column | str, index: Column | int) -> Column:
    """A column's name as it is said; Column N (from 1) if blank."""
    clean = squeeze(F.replace(_col(c), F.lit("_"), F.lit(" ")))
    at = F.lit(index) if isinstance(index, int) else index
    return F.when(clean != "", clean).otherwise(F.concat(F.lit("Column "), (at + 1).cast("string")))


def phrase(head: Column, value: Column) -> Column:
    """A cell under its heading, as a sentence."""
    value = squeeze(value)
    said = F.when(value == "", F.lit("empty.")).when(value.rlike("[.!?]$"), value).otherwise(F.concat(value, F.lit(".")))
    return F.concat(head, F.lit(": "), said)


def sentence(c: Column | str) -> Column:
    """A slide's line with a full stop unless it ends in a mark."""
    c = trim(c)
    return F.when((c == "") | c.rlike("[.!?:;,]$"), c).otherwise(F.concat(c, F.lit(".")))


def natural_key(c: Column | str) -> Column:
    """Array that sorts names as people do: digit runs by value (at most u64's), before lower-cased text, the shorter first."""

    def part(x):
        digits = F.regexp_replace(x, "^0+(?=.)", "")
        top = "18446744073709551615"
        padded = F.lpad(digits, 20, "0")
        number = F.when((F.length(digits) > 20) | (padded > top), F.lit(top)).otherwise(padded)
        return F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), number)).otherwise(F.concat(F.lit("1"), F.lower(x)))

    return F.transform(F.regexp_extract_all(_col(c), F.lit("[0-9]+|[^0-9]+"), F.lit(0)), part)


def fold_ascii(c: Column | str) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
