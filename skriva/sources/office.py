"""Word and slide files to ordered text.

A document's body is a stream of runs and breaks; slides are rows, so hidden ones, numbering and narration are
DataFrame operations. Sizes after inflation are bounded, entities aren't expanded, a broken file is an error row.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import batches_of
from ..functions.text import sentence, tidy, trim
from ..operators.sequences import COLOURS

#: Bytes after inflation: a body, a part, a deck (fixed values).
MOST_BODY, MOST_PART, MOST_DECK = 128 << 20, 32 << 20, 128 << 20
_SKIPPED = frozenset(("pPr", "rPr", "sectPr", "tblPr", "tcPr", "trPr", "numPr"))
_OFF = frozenset(("0", "false", "off"))
#: Highlights by name (fixed values).
HIGHLIGHTS = {
    "black": "black", "blue": "blue", "cyan": "turquoise", "green": "bright green", "magenta": "pink", "red": "red", "yellow": "yellow", "white": "white", "darkBlue": "dark blue", "darkCyan": "teal",
    "darkGreen": "green", "darkMagenta": "violet", "darkRed": "dark red", "darkYellow": "dark yellow", "darkGray": "grey", "lightGray": "light grey",
}


def colour_word(value: str) -> str | None:
    """Name of the nearest colour to RRGGBB; nothing for black or what isn't a colour."""
    value = value.strip().lstrip("#")
    if not re.fullmatch("[0-9A-Fa-f]{6}", value):
        return None
    rgb = int(value, 16)
    name = min(COLOURS, key=lambda n: sum(((rgb >> s & 255) - (COLOURS[n] >> s & 255)) ** 2 for s in (0, 8, 16)))
    return None if name == "black" else name


def part_of(archive: zipfile.ZipFile, name: str, most: int) -> bytes:
    with archive.open(name) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{name} is too large")
    return data


@dataclass
class Piece:
    """A run's text with its format's names, or a break ("\\n" or "\\t"; closing: formats end before it)."""

    text: str
    names: tuple[str, ...] = ()
    is_break: bool = False
    closing: bool = False


def pieces(xml: bytes, formats: bool) -> list[Piece]:
    out: list[Piece] = []
    state: dict = {"skip": 0, "props": False, "in": False, "format": {}}

    def local(name: str) -> str:
        return name.rpartition(":")[2]

    def start(name: str, attrs: dict) -> None:
        tag, get = local(name), {local(k): v for k, v in attrs.items()}.get
        if state["skip"]:
            state["skip"] += tag in _SKIPPED
        elif state["props"]:
            on, f = get("val") not in _OFF, state["format"]
            if tag in ("b", "i"):
                f["bold" if tag == "b" else "italic"] = on
            elif tag == "u":
                f["underline"] = on and get("val") != "none"
            elif tag in ("strike", "dstrike"):
                f["strikethrough"] = on
            elif tag == "color":
                f["colour"] = colour_word(get("val") or "")
            elif tag == "highlight":
                f["highlight"] = HIGHLIGHTS.get((get("val") or "").strip())
        elif formats and tag == "rPr":
            state["props"] = True
        elif tag in _SKIPPED:
            state["skip"] = 1
        elif tag == "r":
            state["format"] = {}
        elif tag == "t":
            state["in"] = True
        elif tag in ("br", "cr", "tab"):
            out.append(Piece("\t" if tag == "tab" else "\n", is_break=True))

    def end(name: str) -> None:
        tag = local(name)
        if state["skip"]:
            state["skip"] -= tag in _SKIPPED
        elif state["props"]:
            state["props"] = tag != "rPr"
        elif tag == "t":
            state["in"] = False
        elif tag == "r":
            state["format"] = {}
        elif tag in ("p", "tr", "tc"):
            out.append(Piece("\t" if tag == "tc" else "\n", is_break=True, closing=True))

    def text(data: str) -> None:
        if state["in"] and not state["skip"] and not state["props"]:
            f = state["format"]
            names = [n for n in ("bold", "italic", "underline", "strikethrough") if f.get(n)]
            names += [f["colour"]] if f.get("colour") else []
            names += [f"highlighted {f['highlight']}"] if f.get("highlight") else []
            out.append(Piece(data, tuple(names)))

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.EntityDeclHandler = lambda *a: (_ for _ in ()).throw(ValueError("entities aren't allowed"))
    parser.Parse(xml, True)
    return out


def spoken(found: list[Piece]) -> str:
    """The text with format changes announced between commas; the document's own mark replaces an announcement's."""
    out, active, fresh = "", (), False

    def announce(name: str) -> None:
        nonlocal out, fresh
        out = out.rstrip(" \t")
        if out and not out.endswith("\n"):
            out = out.rstrip(",") + ", " if out.endswith(",") else out + ", "
        out, fresh = f"{out}{name},", True

    def change(names: tuple[str, ...]) -> None:
        nonlocal active
        for n in (n for n in reversed(active) if n not in names):
            announce(f"end {n}")
        for n in (n for n in names if n not in active):
            announce(n)
        active = names

    for p in found:
        if p.is_break:
            if p.closing:
                change(())
            out = (out[:-1] if fresh and out.endswith(",") else out) + p.text
        else:
            change(p.names)
            if fresh and p.text.lstrip()[:1] in tuple(".,;:!?"):
                out = out.rstrip(",") + p.text.lstrip()
            else:
                out += (" " if fresh and p.text[:1] not in tuple(" \t\n") else "") + p.text
        fresh = False
    change(())
    return out[:-1] if fresh and out.endswith(",") else out


def word_text(content: bytes, formats: bool = False) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        name = "word/document.xml" if "word/document.xml" in names else next((n for n in names if n.startswith("word/document") and n.endswith(".xml")), None)
        if name is None:
            raise ValueError("not a Word document")
        found = pieces(part_of(z, name, MOST_BODY), formats)
    return spoken(found)


def read_word(files: DataFrame, formats: bool = False) -> DataFrame:
    """path, text (tidied), error."""

    def rows(batches):
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    out.append((path, word_text(content.as_py() or b"", formats), None))
                except (zipfile.BadZipFile, expat.ExpatError, ValueError, KeyError, OSError) as problem:
                    out.append((path, None, str(problem)))
            yield from batches_of(out, ["path", "text", "error"], [pa.string()] * 3)

    return files.select("path", "content").mapInArrow(rows, "path string, text string, error string").withColumn("text", tidy("text"))


def resolve(folder: str, target: str) -> str:
    """A relationship's target as a part's name."""
    return target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join("/", folder, target))[1:]


def _tree(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("entities aren't allowed")
    return ElementTree.fromstring(data)


def _named(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == name)


def _relations(data: bytes) -> list[tuple[str, str, str]]:
    return [(e.get("Id"), e.get("Type"), e.get("Target")) for e in _named(_tree(data), "Relationship") if e.get("Id") and e.get("Type") and e.get("Target")]


def slide(data: bytes) -> dict:
    """hidden, title, body, pictures (descriptions, None where there is none) of a slide's part."""
    root = _tree(data)
    out: dict = {"hidden": root.get("show") in ("0", "false"), "title": None, "body": [], "pictures": []}
    for shape in (e for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] in ("sp", "pic", "graphicFrame")):
        tag = shape.tag.rpartition("}")[2]
        if tag == "pic":
            alt = next((e.get("descr") for e in _named(shape, "cNvPr")), None)
            out["pictures"].append(alt.strip() if alt and alt.strip() else None)
            continue
        role = next((e.get("type") for e in _named(shape, "ph")), None)
        if role in ("sldNum", "ftr", "dt", "hdr"):
            continue
        lines = []
        for p in _named(shape, "p"):
            line = "".join("\n" if e.tag.rpartition("}")[2] == "br" else e.text or "" for e in p.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] in ("t", "br"))
            if line.strip():
                lines.append(line.strip())
        if role in ("title", "ctrTitle") and out["title"] is None and lines:
            out["title"] = " ".join(lines)
        else:
            out["body"] += lines
    return out


def slides(content: bytes) -> list[dict]:
    """All slides in the deck's order, with their notes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, spent = set(z.namelist()), 0

        def get(name: str) -> bytes | None:
            nonlocal spent
            if name not in names:
                return None
            data = part_of(z, name, min(MOST_PART, MOST_DECK - spent))
            spent += len(data)
            return data

        order: list[str] = []
        listed, relations = get("ppt/presentation.xml"), get("ppt/_rels/presentation.xml.rels")
        if listed and relations:
            target = {i: t for i, _, t in reversed(_relations(relations))}
            ids = [v for e in _named(_tree(listed), "sldId") for k, v in e.attrib.items() if k.endswith("}id")]
            order = [p for i in ids if i in target and (p := resolve("ppt/", target[i])) in names]
        if not order:
            numbered = {int(m[1]): n for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
            order = [numbered[k] for k in sorted(numbered)]
        out = []
        for part in order:
            made = slide(get(part) or b"") | {"part": part, "notes": None}
            folder, file = posixpath.split(part)
            if (links := get(f"{folder}/_rels/{file}.rels")) and (note := next((t for _, kind, t in _relations(links) if kind.rsplit("/")[-1] == "notesSlide"), None)) and (data := get(resolve(f"{folder}/", note))):
                made["notes"] = "\n".join(slide(data)["body"]).strip() or None
            out.append(made)
    return out


_SLIDE = "path string, part string, pos int, hidden boolean, title string, body array<string>, pictures array<string>, notes string, error string"


def read_slides(files: DataFrame) -> DataFrame:
    """One row a slide, hidden ones too; a file that can't be read is one row with its error."""

    def rows(batches):
        kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
        for b in batches:
            out: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    found = slides(content.as_py() or b"")
                    out += [(path, s["part"], i, s["hidden"], s["title"], s["body"], s["pictures"], s["notes"], None) for i, s in enumerate(found)] or [(path, *[None] * 7, "no slides")]
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, OSError) as problem:
                    out.append((path, *[None] * 7, str(problem)))
            yield from batches_of(out, [c.split()[0] for c in _SLIDE.split(", ")], kinds)

    return files.select("path", "content").mapInArrow(rows, _SLIDE)


def speak_slides(rows: DataFrame) -> DataFrame:
    """path, text and error: the deck's size, then each visible slide by number, with lines, pictures and notes.

    A deck all of whose slides are hidden, or that can't be read, has an error and no text.
    """
    decks = rows.groupBy("path").agg(F.max("error").alias("error"))
    seen = rows.filter("error is null and not hidden")
    w = Window.partitionBy("path")
    n = seen.select("*", F.row_number().over(w.orderBy("pos")).alias("no"), F.count("*").over(w).alias("of"))
    place = F.concat(F.lit("Slide "), F.col("no").cast("string"), F.lit(" of "), F.col("of").cast("string"), F.lit("."))
    head = F.when(F.col("title").isNull(), place).otherwise(sentence(F.concat(place, F.lit(" "), trim("title"))))
    body = F.transform("body", lambda p: F.concat(F.lit("\n"), sentence(p)))
    pictures = F.transform("pictures", lambda p: F.when(p.isNull(), F.lit("\nImage with no description.")).otherwise(F.concat(F.lit("\n"), sentence(F.concat(F.lit("Image: "), p)))))
    notes = F.when(F.col("notes").isNull(), F.lit("")).otherwise(F.concat(F.lit("\n\nSpeaker notes. "), sentence(F.col("notes"))))
    said = n.select("path", "no", "of", F.concat(F.lit("\n\n"), head, F.array_join(body, ""), F.array_join(pictures, ""), notes).alias("said"))
    whole = said.groupBy("path").agg(F.max("of").alias("of"), F.sort_array(F.collect_list(F.struct("no", "said"))).alias("all"))
    size = F.when(F.col("of") == 1, F.lit("1 slide")).otherwise(F.concat(F.col("of").cast("string"), F.lit(" slides")))
    text = whole.select("path", F.concat(F.lit("Presentation with "), size, F.lit("."), F.array_join(F.transform("all", lambda x: x["said"]), "")).alias("text"))
    return decks.join(text, "path", "left").select("path", "text", F.when(F.col("text").isNull(), F.coalesce("error", F.lit("every slide is hidden"))).alias("error"))
