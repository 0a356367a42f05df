"""Quality rules as a short-circuit cascade.

A rule gets the texts that all rules before it kept and says which it rejects. On a sample of the texts that
reach the rules (those that the base test keeps), each rule's seconds a text (cost) are measured; then the rule
that rejects most per cost of what is left of the sample is the next (selectivity, given those before). A
text is kept if no rule rejects it, so the order never changes a verdict. The base counts are asked for of every
row, so what the cascade saves are the rules' own passes over words and letters.

Null text has no words. No words: base_failed. Rules see whole texts.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Texts that the driver samples to order the rules: this alone depends on them.
SAMPLE = 512
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def repeats(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each key, how often it occurs in its row (1: once), as two flags: seen before, occurs again."""
    row = np.repeat(np.arange(len(counts)), counts)
    mixed = shared.mix(keys + row.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    before, more = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]], more[order[:-1]] = same, same
    return np.stack([before, more])


def measures(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    starts, ends, words = shared.spans(buf, off)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = shared.row_sums(lead[ends] - lead[starts], words)
    symbols = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[buf])])[off])
    first, last, lines = shared.spans(buf, off, _NEWLINE)
    some = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    owner = np.repeat(np.arange(len(lines)), lines)[some]
    full = np.bincount(owner, minlength=len(lines))
    again = repeats(shared.hashes(buf, first[some], last[some]), full)[0]
    keys, made = shared.shingles(shared.hashes(buf, starts, ends), words, 3)
    made = np.where(words >= 3, made, 0)
    if len(keys) > made.sum():
        keys = keys[np.repeat(words >= 3, np.where(words >= 3, words - 2, (words > 0)))]
    twice = repeats(keys, made).any(0)
    at = np.repeat(np.cumsum(words) - words, made) + np.arange(len(keys)) - np.repeat(np.cumsum(made) - made, made)
    hit = np.zeros(len(starts) + 3, bool)
    for j in range(3):
        hit[at[twice] + j] = True
    return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": shared.row_sums(again.astype(np.int64), full), "n_repeat_words": shared.row_sums(hit[: len(starts)].astype(np.int64), words), "n_lines": full}


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
Rule = Callable[[dict[str, np.ndarray], list[bytes]], np.ndarray]


def symbol_share(m: dict, _: list[bytes]) -> np.ndarray:
    return 10 * m["n_symbols"] > m["n_words"]


def word_length(m: dict, _: list[bytes]) -> np.ndarray:
    return (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])


def duplicate_lines(m: dict, _: list[bytes]) -> np.ndarray:
    return 2 * m["n_dup_lines"] > m["n_lines"]


def letter_share(m: dict, texts: list[bytes]) -> np.ndarray:
    """Under 60 % of the bytes outside white space are letters or bytes of other scripts."""
    out = []
    for t in texts:
        b = np.frombuffer(t, np.uint8)
        low = b | 0x20
        out.append(5 * int(((low >= 97) & (low <= 122) | (b > 127)).sum()) < 3 * int((~shared.SPACE[b]).sum()))
    return np.array(out, bool)


def top_word(m: dict, texts: list[bytes]) -> np.ndarray:
    """One word makes over 30 % of all words."""
    out = []
    for t in texts:
        words = t.split()
        out.append(10 * max(np.unique(np.array([hash(w) for w in words]), return_counts=True)[1], default=0) > 3 * len(words))
    return np.array(out, bool)


RULES: dict[str, Rule] = {"symbol_share": symbol_share, "word_length": word_length, "duplicate_lines": duplicate_lines, "letter_share": letter_share, "top_word": top_word}


def cascade(m: dict[str, np.ndarray], texts: list[bytes], alive: np.ndarray, order: list[str]) -> np.ndarray:
    """Which texts no rule rejects; a rule sees only those that are still alive."""
    alive = alive.copy()
    for name in order:
        at = np.flatnonzero(alive)
        if not len(at):
            break
        alive[at[RULES[name]({k: v[at] for k, v in m.items()}, [texts[i] for i in at])]] = False
    return alive


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (2 * m["n_repeat_words"] > m["n_words"])


def plan(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """The rules by rejection per cost, measured on a sample of the texts (the lowest hashes of the ids)."""
    rows = docs.select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h").limit(sample)
    ids = [r.doc_id for r in rows.collect()]
    got = docs.filter(F.col("doc_id").isin([i for i in ids if i is not None])).select(F.col("text").cast("string").alias("text")).limit(sample).toArrow()
    texts = [t.encode() for t in got.column(0).to_pylist() if t]
    if not texts:
        return list(RULES)
    m = measures(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    some = np.flatnonzero(~base_failed(m))
    m, texts = {k: v[some] for k, v in m.items()}, [texts[i] for i in some]
    if not texts:
        return list(RULES)
    cost, rejects = {}, {}
    for name, rule in RULES.items():
        began = time.perf_counter()
        rejects[name] = rule(m, texts)
        cost[name] = time.perf_counter() - began + 1e-7
    return greedy(rejects, cost)


def greedy(rejects: dict[str, np.ndarray], cost: dict[str, float]) -> list[str]:
    """The rules, each next one by what it rejects of the texts that are left, per cost."""
    order: list[str] = []
    left = np.ones(len(next(iter(rejects.values()))), bool)
    while len(order) < len(rejects):
        name = max((n for n in rejects if n not in order), key=lambda n: ((rejects[n] & left).mean() + 1e-4) / cost[n])
        order.append(name)
        left &= ~rejects[name]
    return order


def apply(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row; no shuffle."""
    order = order or plan(docs)

    def rows(batches):
        for rows, buf, off in shared.pieces(batches):
            m = measures(buf, off)
            failed = base_failed(m)
            data = buf.tobytes()
            texts = [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            kept = cascade(m, texts, ~failed, order)
            yield shared.as_batch(["doc_id", *BASE, "base_failed", "kept"], [rows.column(0), *(m[k] for k in BASE), failed, kept], [pa.int64()] * 6 + [pa.bool_()] * 2)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shared.arrow(picked, rows, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean")
