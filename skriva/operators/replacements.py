"""Replacement rules that are a table: thousands of them, in turn, in a plan that doesn't grow with them."""

from __future__ import annotations

import heapq
import re
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules and characters of rules that are broadcast at once; more of them run in several passes.
MOST_RULES, MOST_CHARS = 200_000, 16_000_000
_RULES: dict = {}


#: Words whose results a worker keeps, and their greatest length.
WORDS, LONG = 1 << 18, 100


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def split(text: str) -> list[str]:
    """What is between the words of a text, and its words, in turn: words are at the odd places."""
    return _word_runs(128 if text.isascii() else 0x110000 if _ASTRAL.search(text) else 0x10000).split(text)


@lru_cache(3)
def _word_runs(below: int) -> re.Pattern:
    """Runs of the letters of a word in texts of lower code points; of those of two code units each range would be tried at what is no letter."""
    runs = regex.finditer(r"[\p{Alphabetic}\p{N}'’]+", "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(below)))
    return re.compile("([" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in (r.span() for r in runs)) + "]+)")


@lru_cache(1 << 16)
def _is_word(c: str) -> bool:
    return regex.match(r"[\p{Alphabetic}\p{N}'’]", c) is not None


def keyed(text: str) -> str:
    """The text in lower case, letter by letter and as long as it was; two letters are the same if their keys are."""
    low = text.lower()
    if len(low) != len(text) or "Σ" in text:
        low = "".join(k if len(k := c.lower()) == 1 else c for c in text)
    return low


def _capital(text: str) -> bool:
    """Whether the first of its letters is a capital."""
    first = regex.search(r"\p{Alphabetic}", text)
    return first is not None and regex.match(r"\p{Uppercase}", first[0]) is not None


class Rules:
    """Rules (find, to, whole word) in their order.

    Where all are of whole words and of letters of a word alone, each word of a text is taken for itself: no rule sees beyond
    it, and what comes in its place joins none of its neighbours. Else an automaton tells which rules a text may match.
    """

    def __init__(self, rules: list[tuple[str, str, bool]]):
        self.rules = [(keyed(find), to, to[:1].upper() + to[1:], whole) for find, to, whole in rules]
        self.longest = max(len(r[0]) for r in self.rules)
        self.by_find: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            self.by_find.setdefault(r[0], []).append(i)
        self.by_word = all(whole and split(find) == ["", find, ""] for find, _, _, whole in self.rules)
        self.known: dict[str, tuple[str, int]] = {}
        if not self.by_word:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for find, which in self.by_find.items():
                self.automaton.add_word(find, which)
            self.automaton.make_automaton()

    def apply(self, text: str) -> tuple[str, int]:
        """(text, replacements made)."""
        return self._by_words(text) if self.by_word else self._in_turn(text)

    def _by_words(self, text: str) -> tuple[str, int]:
        parts, made = split(text), 0
        for i in range(1, len(parts), 2):
            word = parts[i]
            got = self.known.get(word)
            if got is None:
                got = self._word(word)
                if len(self.known) >= WORDS:
                    self.known.clear()
                if len(word) <= LONG:
                    self.known[word] = got
            parts[i] = got[0]
            made += got[1]
        return "".join(parts), made

    def _word(self, word: str) -> tuple[str, int]:
        """What a word becomes: the first rule of its letters, then later ones for the words of what that brings in."""
        out: list[str] = []
        made, waiting = 0, [(word, -1)]
        while waiting:
            text, after = waiting.pop()
            which = self.by_find.get(keyed(text), ())
            at = bisect_right(which, after)
            if at == len(which):
                out.append(text)
                continue
            made += 1
            _, to, big, _ = self.rules[which[at]]
            waiting += [(p, which[at]) for p in reversed(split(big if _capital(text) else to)) if p]
        return "".join(out), made

    def _in_turn(self, text: str) -> tuple[str, int]:
        """(text, replacements made). Only rules whose letters are in the text, or come into it, are tried."""
        key, made = keyed(text), 0
        known = {i for _, which in self.automaton.iter(key) for i in which}
        waiting = sorted(known)
        while waiting:
            now = heapq.heappop(waiting)
            text, key, spans = self._one(text, key, now)
            made += len(spans)
            reach, end = self.longest - 1, 0
            for a, b in spans:
                # what a replacement brings in or joins lies within a rule's length of it; what is searched is once
                start, end = max(a - reach, end - reach, 0), min(b + reach, len(key))
                for _, which in self.automaton.iter(key, start, end):
                    for i in which:
                        if i > now and i not in known:
                            known.add(i)
                            heapq.heappush(waiting, i)
        return text, made

    def _one(self, text: str, key: str, which: int) -> tuple[str, str, list[tuple[int, int]]]:
        """The text after one rule, its key, and where the replacements are in it."""
        find, to, big, whole = self.rules[which]
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        done = size = 0
        at = key.find(find)
        while at >= 0:
            end = at + len(find)
            if whole and (at and _is_word(text[at - 1]) or end < len(text) and _is_word(text[end])):
                at = key.find(find, at + 1)
                continue
            new = big if _capital(text[at:end]) else to
            parts += [text[done:at], new]
            size += at - done + len(new)
            spans.append((size - len(new), size))
            done, at = end, key.find(find, end)
        if not spans:
            return text, key, spans
        text = "".join([*parts, text[done:]])
        return text, keyed(text), spans


def replaced(df: DataFrame, column: str, rules: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with said, its column after all rules (position, find, to, whole_word) in turn, and made, how many replacements.

    Each rule runs over the result of those before, over all of the text before the next one. A rule whose find is blank
    isn't used; of rules at one position that with the smaller find, then to, is the first; without a to it removes, without
    a whole_word it is of whole words. Null texts stay null with nothing made; without rules texts stay as they are.

    Rules are broadcast up to MOST_RULES and MOST_CHARS. More go in several passes, in order; write puts the table between
    two passes in the shared folder and reads it back, so that no worker holds more than one pass's rules.
    """
    if {"said", "made"} & set(df.columns):
        raise ValueError("said and made are columns of the result")
    order = ["position", "find", "to", "whole_word"]
    usable = rules.select("position", "find", F.coalesce("to", F.lit("")).alias("to"), F.coalesce("whole_word", F.lit(True)).alias("whole_word")).filter(r"find rlike '(?U)\\S'")
    df = df.withColumn("said", F.col(column).cast("string")).withColumn("made", F.lit(0).cast("long"))
    first = True
    for some in _passes((r.find.strip(), r.to, r.whole_word) for r in usable.orderBy(*order).toLocalIterator()):
        df = _pass(df if first else write(df), some)
        first = False
    return df


def _passes(rules: Iterator[tuple[str, str, bool]]) -> Iterator[list[tuple[str, str, bool]]]:
    some, chars = [], 0
    for r in rules:
        if some and (len(some) >= MOST_RULES or chars + len(r[0]) + len(r[1]) > MOST_CHARS):
            yield some
            some, chars = [], 0
        some.append(r)
        chars += len(r[0]) + len(r[1])
    if some:
        yield some


def _ready(name: str, sent) -> Rules:
    """The rules of a pass, once in each worker."""
    if name not in _RULES:
        _RULES.clear()
        _RULES[name] = Rules(sent.value)
    return _RULES[name]


def _pass(df: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    sent, name = df.sparkSession.sparkContext.broadcast(rules), uuid.uuid4().hex
    said, made = df.columns.index("said"), df.columns.index("made")

    def rows(batches):
        for b in batches:
            ready = _ready(name, sent)
            got = [(None, 0) if t is None else ready.apply(t) for t in b.column(said).to_pylist()]
            columns = list(b.columns)
            columns[said] = pa.array([t for t, _ in got], pa.string())
            columns[made] = pa.array([m + n for (_, n), m in zip(got, b.column(made).to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return df.mapInArrow(rows, df.schema)
