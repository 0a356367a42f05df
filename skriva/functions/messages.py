"""Localised messages: language files, plural forms, fallback and templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import batches_of

#: Plural rules by name (fixed values).
RULES = ("one_other", "french", "polish", "russian")
_ENTRY = re.compile(r'"((?:[^"\\]|\\.)*)("?)(.*)', re.S)
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\"}


def value_of(text: str) -> tuple[str | None, str | None]:
    """(value, None) of a quoted value, or (None, what is wrong)."""
    m = _ENTRY.match(text)
    if not m:
        return None, "a value has to be wrapped in double quotes"
    body, closed, rest = m.groups()
    bad = next((e[1] for e in re.finditer(r"\\(.)", body, re.S) if e[1] not in _ESCAPES), None)
    if bad:
        return None, f"`\\{bad}` is not an escape this format knows"
    if not closed:
        return None, "the line ends in a backslash" if rest.startswith("\\") else "the closing quote is missing"
    if rest.strip() and not rest.strip().startswith("#"):
        return None, f"`{rest.strip()}` is left over after the closing quote"
    return re.sub(r"\\(.)", lambda e: _ESCAPES[e[1]], body, flags=re.S), None


def parse(text: str) -> Iterator[tuple[str | None, str | None, int, str | None]]:
    """(key, value, line, None) of each entry, the last of a key alone, and (None, None, line, problem)."""
    entries: dict[str, list] = {}
    problems: list[tuple[int, str]] = []
    above: str | None = None
    for line, raw in enumerate(text.splitlines(), 1):
        s = raw.strip()
        if not s:
            above = None
        if not s or s.startswith("#"):
            continue
        if s.startswith('"'):
            more, wrong = value_of(s)
            if above is None:
                problems.append((line, "a continued line with no entry above it to continue"))
            elif wrong:
                problems.append((line, wrong))
            else:
                entries[above][0] += more
            continue
        key, equals, rest = s.partition("=")
        key, above = key.strip(), None
        if not equals:
            problems.append((line, "no `=`, so this is neither a comment nor an entry"))
        elif bad := re.search(r"[^a-z0-9._]", key):
            problems.append((line, f"`{bad[0]}` cannot appear in a key"))
        else:
            value, wrong = value_of(rest.strip())
            if wrong:
                problems.append((line, wrong))
                continue
            if key in entries:
                problems.append((line, f"`{key}` was already given a value further up"))
            entries[key], above = [value, line], key
    yield from ((k, v, line, None) for k, (v, line) in entries.items())
    yield from ((None, None, line, what) for line, what in problems)


def read_languages(files: DataFrame) -> DataFrame:
    """lang (the file's code entry), key, value, line and problem of (path, text)."""

    def rows(batches):
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                got = list(parse(text or ""))
                code = next((v for k, v, _, _ in got if k == "code"), "")
                out += [(code, *g) for g in got]
            yield from batches_of(out, ["lang", "key", "value", "line", "problem"], [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()])

    return files.select("text").mapInArrow(rows, "lang string, key string, value string, line int, problem string")


def category(rule: Column, n: Column) -> Column:
    """one, few, many or other."""
    few = (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
    slavic = F.when(few, "few").otherwise("many")
    return (
        F.when(rule == "french", F.when(n <= 1, "one").otherwise("other"))
        .when(rule == "polish", F.when(n == 1, "one").otherwise(slavic))
        .when(rule == "russian", F.when((n % 10 == 1) & (n % 100 != 11), "one").otherwise(slavic))
        .otherwise(F.when(n == 1, "one").otherwise("other"))
    )


def plural_form(forms: Column, wanted: Column) -> Column:
    """From a map of forms: the wanted one, else other, many, one."""
    get = lambda k: F.try_element_at(forms, k)
    return F.coalesce(get(wanted), get(F.lit("other")), get(F.lit("many")), get(F.lit("one")))


#: What a template is cut at: a doubled brace, or an opening one up to its end.
_SLOT = r"\{\{|\}\}|\{[^}]*\}?"


def filled(template: Column, values: Column) -> Column:
    """The template with {name} by its value in the map; {{ and }} are braces, and a name that isn't in the map stays.

    The template is cut once and each slot looked up, so what values hold is never read as a slot. A name that the
    template's end leaves open counts if it is in the map.
    """
    slots = F.regexp_extract_all(template, F.lit(_SLOT), F.lit(0))
    gaps = F.split(template, _SLOT, -1)
    name = lambda x: F.regexp_extract(x, r"^\{([^}]*)\}?$", 1)
    one = lambda x: F.when(x == "{{", F.lit("{")).when(x == "}}", F.lit("}")).otherwise(F.coalesce(F.try_element_at(values, name(x)), x))
    pairs = F.zip_with(slots, F.slice(gaps, F.lit(2), F.size(slots)), lambda x, gap: F.concat(one(x), gap))
    return F.concat(gaps[0], F.array_join(pairs, ""))


def normal_code(code: Column) -> Column:
    return F.replace(F.lower(F.trim(code)), F.lit("_"), F.lit("-"))


def matched_language(wanted: Column, have: list[str], english: str = "en") -> Column:
    """The language to use: the same code, else the same primary part, else English."""
    w = normal_code(wanted)
    norm = {h: h.strip().lower().replace("_", "-") for h in have}
    ranked = [F.when(w == norm[h], F.struct(F.lit(0).alias("tier"), F.lit(i).alias("i"), F.lit(h).alias("code"))) for i, h in enumerate(have)]
    ranked += [F.when(F.split(w, "-")[0] == norm[h].split("-")[0], F.struct(F.lit(1).alias("tier"), F.lit(i).alias("i"), F.lit(h).alias("code"))) for i, h in enumerate(have)]
    best = F.array_min(F.array_compact(F.array(*ranked)))
    return F.coalesce(best["code"], F.lit(english))


def override(built_in: DataFrame, folder: DataFrame, english: str = "en") -> DataFrame:
    """lang, key, value: a folder's language replaces the built-in one of its code, never English; others are added."""
    own = folder.withColumn("__c", normal_code(F.col("lang"))).filter(F.col("__c") != english)
    kept = built_in.withColumn("__c", normal_code(F.col("lang"))).join(own.select("__c").distinct(), "__c", "left_anti")
    return kept.unionByName(own, allowMissingColumns=True).select("lang", "key", "value")


def looked_up(requests: DataFrame, entries: DataFrame, lang: str, english: str = "en") -> DataFrame:
    """requests with text: the key's value in lang, else in English, else the key itself."""
    own = entries.filter(F.col("lang") == lang).select("key", F.col("value").alias("__own"))
    base = entries.filter(F.col("lang") == english).select("key", F.col("value").alias("__base"))
    return requests.join(own, "key", "left").join(base, "key", "left").withColumn("text", F.coalesce("__own", "__base", "key")).drop("__own", "__base")
