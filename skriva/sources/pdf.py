"""PDF files to ordered text by page, with what was lost counted.

Objects are found by scanning the whole file, so a useless cross-reference table does no harm; the last
definition of a number wins. Page text follows the drawing instructions; gaps and line breaks come from
positions. Depths, counts and inflated sizes are bounded. A file that can't be read is a row with its error.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batches_of
from ..functions.text import tidy
from ..operators.sequences import assemble_pages, garbled, within_budget

#: File and stream bytes, pages, nesting, form depth (fixed values).
MOST_FILE, MOST_STREAM, MOST_PAGES, NESTING, FORMS = 128 << 20, 128 << 20, 50_000, 64, 8
#: Bytes of text after which the pages of a file are left out; the page that passes it is kept (fixed value).
MOST_CHARS = 16 << 20
#: Same line under so much of the size; a gap over or under so many ems; a new line under so much (fixed values).
SAME_LINE, GAP, BACK, NEXT_LINE = 0.4, 0.2, -1.0, 1.9
_SPACE, _DELIM = b" \t\r\n\f\0", b"()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_BLANK = re.compile(rb"(?:[ \t\r\n\f\0]+|%[^\r\n]*)*")
_NAME, _WORD, _ESCAPED = re.compile(rb"[^\s\0()<>\[\]{}/%]*"), re.compile(rb"[^\s\0()<>\[\]{}/%]+"), re.compile(rb"#([0-9A-Fa-f]{2})")
_REF, _OCTAL, _MARK = re.compile(rb"\s+\d+\s+R(?![A-Za-z])"), re.compile(rb"[0-7]{1,3}"), re.compile(rb"[\\()]")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
#: Glyph names that Unicode's own names don't give by rule (fixed values).
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+",
    "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“",
    "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl",
    "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı", "lslash": "ł", "Lslash": "Ł", "sterling": "£", "Euro": "€", "yen": "¥", "cent": "¢",
    "section": "§", "paragraph": "¶", "degree": "°", "copyright": "©", "registered": "®", "trademark": "™", "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›",
    "exclamdown": "¡", "questiondown": "¿", "multiply": "×", "divide": "÷", "plusminus": "±", "periodcentered": "·", "nbspace": " ", "mu": "µ", "minus": "−", "dagger": "†", "daggerdbl": "‡",
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "zero": "0", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ",
}
_MARKS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌"}


class Name(str):
    """A name; strings are bytes."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    data: bytes


class Word(bytes):
    """An operator or keyword."""


class Lexer:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _BLANK.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        """The next value; a Word for an operator; None for null; EOFError at the end."""
        self.skip()
        d, i = self.data, self.at
        if i >= len(d):
            raise EOFError
        if depth > NESTING:
            raise ValueError("nested too deep")
        c = d[i : i + 1]
        if c == b"/":
            m = _NAME.match(d, i + 1)
            self.at = m.end()
            return Name((_ESCAPED.sub(lambda x: bytes([int(x[1], 16)]), m[0]) if b"#" in m[0] else m[0]).decode("latin-1"))
        if c == b"(":
            return self.text()
        if d[i : i + 2] == b"<<":
            self.at += 2
            out: dict = {}
            while True:
                self.skip()
                if d[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key = self.value(depth + 1)
                if not isinstance(key, Name):
                    continue
                out[str(key)] = self.operand(depth + 1)
        if c == b"<":
            end = d.find(b">", i)
            end = len(d) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[i + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            items: list = []
            while True:
                self.skip()
                if self.at >= len(d):
                    return items
                if d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                items.append(self.operand(depth + 1))
        if m := _NUMBER.match(d, i):
            self.at = m.end()
            return float(m[0]) if b"." in m[0] else int(m[0])
        m = _WORD.match(d, i)
        self.at = m.end() if m else i + 1
        word = m[0] if m else c
        return {b"true": True, b"false": False, b"null": None}[word] if word in (b"true", b"false", b"null") else Word(word)

    def operand(self, depth: int = 0):
        """A value, or a reference if two numbers and R follow."""
        v = self.value(depth)
        if isinstance(v, int) and not isinstance(v, bool) and (m := _REF.match(self.data, self.at)):
            self.at = m.end()
            return Ref(v)
        return v

    def text(self) -> bytes:
        d, out, depth = self.data, bytearray(), 0
        self.at += 1
        while self.at < len(d):
            mark = _MARK.search(d, self.at)
            if mark is None:
                out += d[self.at :]
                self.at = len(d)
                break
            out += d[self.at : mark.start()]
            c = d[mark.start()]
            self.at = mark.end()
            if c == 92:
                e = d[self.at : self.at + 1]
                self.at += 1
                if e in b"01234567" and e:
                    m = _OCTAL.match(d, self.at - 1)
                    self.at = m.end()
                    out.append(int(m[0], 8) & 255)
                elif e == b"\r":
                    self.at += d[self.at : self.at + 1] == b"\n"
                elif e != b"\n":
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
                continue
            if c == 40:
                depth += 1
            elif c == 41:
                if not depth:
                    return bytes(out)
                depth -= 1
            out.append(c)
        return bytes(out)


def inflate(data: bytes) -> bytes:
    """What can be inflated, with a header or raw; a broken end keeps what came before."""
    for bits, start in ((15, 0), (-15, 0), (15, 1)):
        d, out = zlib.decompressobj(bits), b""
        try:
            for i in range(start, len(data), 1 << 16):
                out += d.decompress(data[i : i + (1 << 16)], MOST_STREAM - len(out))
        except zlib.error:
            pass
        if out:
            return out
    return b""


def lzw(data: bytes, early: int = 1) -> bytes:
    out, table, width, prev, buffer, have = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, b"", 0, 0
    for byte in data:
        buffer, have = buffer << 8 | byte, have + 8
        while have >= width:
            code = buffer >> (have - width) & ((1 << width) - 1)
            have -= width
            buffer &= (1 << have) - 1
            if code == 257 or len(out) > MOST_STREAM:
                return bytes(out)
            if code == 256:
                table, width, prev = table[:258], 9, b""
                continue
            entry = table[code] if code < len(table) else prev + prev[:1]
            if not entry:
                return bytes(out)
            out += entry
            if prev and len(table) < 4096:
                table.append(prev + entry[:1])
            prev = entry
            width = next((w for w in (9, 10, 11) if len(table) + early < 1 << w), 12)
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data:
        if c == 126:
            break
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128 and len(out) < MOST_STREAM:
        n = data[i]
        out += data[i + 1 : i + 2 + n] if n < 128 else data[i + 1 : i + 2] * (257 - n)
        i += n + 2 if n < 128 else 2
    return bytes(out)


def unpredict(data: bytes, p: dict) -> bytes:
    kind, colours, bits, columns = (p.get(k, d) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if not isinstance(kind, int) or kind < 2:
        return data
    step, size = max(1, colours * bits // 8), (colours * bits * columns + 7) // 8
    out = bytearray()
    if kind == 2:
        for r in range(0, len(data), size):
            row = bytearray(data[r : r + size])
            if bits == 8:
                for i in range(step, len(row)):
                    row[i] = (row[i] + row[i - step]) & 255
            out += row
        return bytes(out)
    before = bytes(size)
    for r in range(0, len(data), size + 1):
        how, row = data[r], bytearray(data[r + 1 : r + 1 + size])
        for i in range(len(row)):
            a, b, c = row[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
            if how == 4:
                q = a + b - c
                add = min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2]
            else:
                add = (0, a, b, (a + b) // 2)[how] if how < 4 else 0
            row[i] = (row[i] + add) & 255
        before = bytes(row) + bytes(size - len(row))
        out += row
    return bytes(out)


class Document:
    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("not a PDF")
        self.objects: dict[int, object] = {}
        self.trailers: list[dict] = []
        for m in _OBJECT.finditer(data):
            try:
                self.objects[int(m[1])] = self._object(data, m.end())
            except (EOFError, ValueError, RecursionError):
                continue
        for m in re.finditer(rb"\btrailer\b", data):
            try:
                t = Lexer(data, m.end()).value()
                self.trailers += [t] if isinstance(t, dict) else []
            except (EOFError, ValueError):
                continue
        self.trailers += [o.info for o in self.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "XRef"]
        for holder in [o for o in self.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "ObjStm"]:
            self._expand(holder)
        if any(self.get(t.get("Encrypt")) is not None for t in self.trailers):
            raise ValueError("encrypted")

    def _object(self, data: bytes, at: int):
        lexer = Lexer(data, at)
        v = lexer.operand()
        lexer.skip()
        if not isinstance(v, dict) or data[lexer.at : lexer.at + 6] != b"stream":
            return v
        start = lexer.at + 6
        start += 2 if data[start : start + 2] == b"\r\n" else data[start : start + 1] in (b"\n", b"\r")
        n = v.get("Length")
        if isinstance(n, int) and re.compile(rb"\s*endstream").match(data, start + n):
            return Stream(v, data[start : start + n])
        end = data.find(b"endstream", start)
        return Stream(v, data[start : end if end >= 0 else len(data)].removesuffix(b"\n").removesuffix(b"\r"))

    def _expand(self, holder: Stream) -> None:
        try:
            data, n, first = self.decoded(holder), self.get(holder.info.get("N")), self.get(holder.info.get("First"))
            head = [int(x) for x in data[:first].split()[: 2 * n]]
            for number, at in zip(head[::2], head[1::2], strict=False):
                if not isinstance(self.objects.get(number), Stream):
                    self.objects[number] = Lexer(data, first + at).operand()
        except (EOFError, ValueError, TypeError):
            return

    def get(self, v, hops: int = 32):
        while isinstance(v, Ref) and hops:
            v, hops = self.objects.get(v.number), hops - 1
        return None if isinstance(v, Ref) else v

    def dict_of(self, v) -> dict:
        v = self.get(v)
        return v if isinstance(v, dict) else v.info if isinstance(v, Stream) else {}

    def decoded(self, s: Stream) -> bytes:
        names, params = self.get(s.info.get("Filter", s.info.get("F"))), self.get(s.info.get("DecodeParms", s.info.get("DP")))
        names = [names] if isinstance(names, Name) else names or []
        params = params if isinstance(params, list) else [params] * len(names)
        data = s.data
        for i, name in enumerate(names):
            p = {k: self.get(v) for k, v in self.dict_of(params[i] if i < len(params) else None).items()}
            name = self.get(name)
            if name in ("FlateDecode", "Fl"):
                data = unpredict(inflate(data), p)
            elif name in ("LZWDecode", "LZW"):
                data = unpredict(lzw(data, p.get("EarlyChange", 1)), p)
            elif name in ("ASCIIHexDecode", "AHx"):
                h = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
            elif name in ("ASCII85Decode", "A85"):
                data = ascii85(data.removeprefix(b"<~"))
            elif name in ("RunLengthDecode", "RL"):
                data = run_length(data)
            elif name != "Crypt":
                raise ValueError(f"no text in {name}")
        return data

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """(page, its resources, own or inherited), in order; without a tree, loose pages by number."""
        root = next((r for t in reversed(self.trailers) if (r := self.dict_of(t.get("Root")))), None) or next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
        todo, seen, n = [(root.get("Pages"), {})], set(), 0
        while todo and n < MOST_PAGES:
            node, above = todo.pop()
            if isinstance(node, Ref) and node.number in seen:
                continue
            seen |= {node.number} if isinstance(node, Ref) else set()
            d = self.dict_of(node)
            own = self.dict_of(d.get("Resources")) or above
            if isinstance(kids := self.get(d.get("Kids")), list):
                todo += [(k, own) for k in reversed(kids)]
            elif d:
                n += 1
                yield d, own
        if not n:
            yield from ((o, self.dict_of(o.get("Resources"))) for _, o in sorted(self.objects.items(), key=lambda x: x[0]) if isinstance(o, dict) and o.get("Type") == "Page")

    def contents(self, page: dict) -> bytes:
        parts = self.get(page.get("Contents"))
        out = []
        for p in parts if isinstance(parts, list) else [parts]:
            if isinstance(s := self.get(p), Stream):
                try:
                    out.append(self.decoded(s))
                except ValueError:
                    continue
        return b"\n".join(out)


def glyph(name: str) -> str | None:
    """Text of a glyph's name: a letter, uniXXXX, uXXXX to uXXXXXX, a listed name, or a letter with a mark."""
    name = name.partition(".")[0]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        return chr(int(m[1] or m[2], 16)) if int(m[1] or m[2], 16) < 0x110000 else None
    if name in GLYPHS:
        return GLYPHS[name]
    if name[:1].isalpha() and name[1:] in _MARKS:
        made = unicodedata.normalize("NFC", name[0] + _MARKS[name[1:]])
        return made if len(made) == 1 else None
    return None


@dataclass
class Font:
    wide: bool
    table: dict[int, str] = field(default_factory=dict)
    unicode: dict[bytes, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    default: float = 0.5
    known: dict[bytes, tuple[str | None, float]] = field(default_factory=dict)

    def codes(self, text: bytes) -> Iterator[bytes]:
        step = 2 if self.wide else 1
        return (text[i : i + step] for i in range(0, len(text), step))

    def decode(self, code: bytes) -> str | None:
        return self.unicode.get(code, self.table.get(int.from_bytes(code, "big")) if not self.wide else None)

    def told(self, code: bytes) -> tuple[str | None, float]:
        """The code's text and width."""
        if code not in self.known:
            self.known[code] = self.decode(code), self.widths.get(int.from_bytes(code, "big"), self.default)
        return self.known[code]


def cmap(data: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", data, re.S):
        lexer, items = Lexer(body), []
        try:
            while True:
                items.append(lexer.value())
        except (EOFError, ValueError):
            pass
        if kind == b"char":
            out.update({a: text(b) for a, b in zip(items[::2], items[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes) and len(a) <= 4})
            continue
        for a, b, to in zip(items[::3], items[1::3], items[2::3], strict=False):
            if not isinstance(a, bytes) or not isinstance(b, bytes) or len(a) > 4:
                continue
            low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
            if not 0 <= high - low <= 65_536:
                continue
            for i in range(high - low + 1):
                code = (low + i).to_bytes(len(a), "big")
                if isinstance(to, list):
                    if i < len(to) and isinstance(to[i], bytes):
                        out[code] = text(to[i])
                elif isinstance(to, bytes) and len(to) >= 2:
                    out[code] = text(to[:-2] + ((int.from_bytes(to[-2:], "big") + i) & 0xFFFF).to_bytes(2, "big"))
    return out


def font_of(doc: Document, info: dict) -> Font:
    wide, base = info.get("Subtype") == "Type0", str(info.get("BaseFont", ""))
    font = Font(wide, default=0.6 if "Courier" in base else 0.5)
    if isinstance(s := doc.get(info.get("ToUnicode")), Stream):
        try:
            font.unicode = cmap(doc.decoded(s))
        except ValueError:
            pass
    if wide:
        below = doc.dict_of((doc.get(info.get("DescendantFonts")) or [None])[0])
        font.default = (doc.get(below.get("DW")) or 1000) / 1000
        w, i = doc.get(below.get("W")) or [], 0
        while i + 1 < len(w):
            first, second = doc.get(w[i]), doc.get(w[i + 1])
            if isinstance(second, list):
                font.widths.update({first + k: doc.get(x) / 1000 for k, x in enumerate(second) if isinstance(doc.get(x), int | float)})
                i += 2
            elif i + 2 < len(w):
                font.widths.update(dict.fromkeys(range(first, min(second, first + 65_536) + 1), (doc.get(w[i + 2]) or 0) / 1000))
                i += 3
            else:
                break
        return font
    first = doc.get(info.get("FirstChar")) or 0
    font.widths = {first + k: x / 1000 for k, w in enumerate(doc.get(info.get("Widths")) or []) if isinstance(x := doc.get(w), int | float)}
    encoding = doc.get(info.get("Encoding"))
    name = str(doc.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding)
    pictures = any(p in base for p in ("Symbol", "ZapfDingbats"))
    if not pictures:
        codec = "mac_roman" if name == "MacRomanEncoding" else "cp1252"
        font.table = {i: c for i in range(32, 256) if (c := bytes([i]).decode(codec, "ignore"))}
        if name not in ("WinAnsiEncoding", "MacRomanEncoding"):
            font.table |= {39: "’", 96: "‘"} if info.get("Subtype") == "Type1" and name == "StandardEncoding" else {}
    at = 0
    for x in (doc.get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
        if isinstance(x, int):
            at = x
        elif isinstance(x, Name):
            got = glyph(x)
            font.table.pop(at, None)
            if got is not None:
                font.table[at] = got
            at += 1
    return font


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Page:
    """Runs a page's instructions; text, and how many glyphs were kept and dropped."""

    def __init__(self, doc: Document):
        self.doc, self.out, self.kept, self.dropped = doc, [], 0, 0
        self.end: tuple[float, float, float] | None = None
        self.fonts: dict[int, Font] = {}

    def run(self, data: bytes, resources: dict, ctm: tuple = _ONE, depth: int = 0, inside: frozenset = frozenset()) -> None:
        lexer, args, saved = Lexer(data), [], []
        s = {"font": None, "size": 0.0, "lead": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "ctm": ctm}
        tm = line = _ONE

        def show(text: bytes) -> None:
            nonlocal tm
            tm = self._show(text, s, tm)

        def move(x: float, y: float) -> None:
            nonlocal tm, line
            tm = line = _times((1, 0, 0, 1, x, y), line)

        while True:
            try:
                v = lexer.value()
            except (EOFError, ValueError):
                return
            if not isinstance(v, Word):
                args = [*args[-7:], v]
                continue
            num = [a for a in args if isinstance(a, int | float) and not isinstance(a, bool)]
            if v == b"q":
                saved.append(dict(s))
            elif v == b"Q" and saved:
                s = saved.pop()
            elif v == b"cm" and len(num) >= 6:
                s["ctm"] = _times(tuple(num[-6:]), s["ctm"])
            elif v == b"BT":
                tm = line = _ONE
            elif v == b"Tf" and len(args) >= 2 and isinstance(args[-2], Name) and num:
                s["font"], s["size"] = self._font(resources, args[-2]), float(num[-1])
            elif v in (b"TL", b"Tc", b"Tw", b"Tz") and num:
                s[{b"TL": "lead", b"Tc": "char", b"Tw": "word", b"Tz": "scale"}[bytes(v)]] = num[-1] / (100 if v == b"Tz" else 1)
            elif v in (b"Td", b"TD") and len(num) >= 2:
                if v == b"TD":
                    s["lead"] = -num[-1]
                move(num[-2], num[-1])
            elif v == b"Tm" and len(num) >= 6:
                tm = line = tuple(float(x) for x in num[-6:])
            elif v == b"T*":
                move(0, -s["lead"])
            elif v == b"Tj" and args and isinstance(args[-1], bytes):
                show(args[-1])
            elif v in (b"'", b'"') and args and isinstance(args[-1], bytes):
                if v == b'"' and len(num) >= 2:
                    s["word"], s["char"] = num[-2], num[-1]
                move(0, -s["lead"])
                show(args[-1])
            elif v == b"TJ" and args and isinstance(args[-1], list):
                for x in args[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    elif isinstance(x, int | float):
                        tm = _times((1, 0, 0, 1, -x / 1000 * s["size"] * s["scale"], 0), tm)
            elif v == b"Do" and args and isinstance(args[-1], Name) and depth < FORMS:
                ref = self.doc.dict_of(resources.get("XObject")).get(str(args[-1]))
                form, key = self.doc.get(ref), ref.number if isinstance(ref, Ref) else id(ref)
                if isinstance(form, Stream) and form.info.get("Subtype") == "Form" and key not in inside:
                    try:
                        m = [self.doc.get(x) for x in self.doc.get(form.info.get("Matrix")) or _ONE]
                        self.run(self.doc.decoded(form), self.doc.dict_of(form.info.get("Resources")) or resources, _times(tuple(m), s["ctm"]), depth + 1, inside | {key})
                    except (ValueError, TypeError):
                        pass
            elif v == b"BI":
                m = re.compile(rb"[\s\0]EI(?=[\s\0]|\Z)").search(lexer.data, lexer.at)
                lexer.at = m.end() if m else len(lexer.data)
            args = []

    def _font(self, resources: dict, name: Name) -> Font:
        ref = self.doc.dict_of(resources.get("Font")).get(str(name))
        key = ref.number if isinstance(ref, Ref) else id(ref)
        if key not in self.fonts:
            try:
                self.fonts[key] = font_of(self.doc, self.doc.dict_of(ref))
            except (TypeError, ValueError, AttributeError):
                self.fonts[key] = Font(False)
        return self.fonts[key]

    def _show(self, text: bytes, s: dict, tm: tuple) -> tuple:
        """Within a string each glyph begins where the one before ends, so only the first may be parted from what came before."""
        font = s["font"] or Font(False)
        if not text:
            return tm
        at, ctm = _times(tm, s["ctm"]), s["ctm"]
        size = abs(s["size"]) * max(abs(at[0] * at[3] - at[1] * at[2]), 1e-9) ** 0.5 or 1.0
        x, y, right, down, scale = tm[4], tm[5], tm[0], tm[1], s["scale"]
        em, char, word, said, dropped = s["size"], s["char"], s["word"], [], 0
        for n, code in enumerate(font.codes(text)):
            got, width = font.told(code)
            if got is None:
                dropped += 1
            elif n:
                said.append(got)
            else:
                self._put(got, at[4], at[5], size)
            step = (width * em + char + (word if code == b" " else 0)) * scale
            x, y = step * right + x, step * down + y
        self.out += said
        self.dropped += dropped
        self.kept += n + 1 - dropped
        tm = (*tm[:4], x, y)
        end = _times(tm, ctm)
        self.end = (end[4], end[5], size)
        return tm

    def _put(self, text: str, x: float, y: float, size: float) -> None:
        if self.end and self.out:
            px, py, psize = self.end
            unit = max(size, psize)
            down, right = py - y, (x - px) / unit
            if abs(down) < SAME_LINE * unit:
                gap = " " if right > GAP or right < BACK else ""
            else:
                gap = "\n" if 0 < down < NEXT_LINE * unit else "\n\n"
            last = self.out[-1][-1:]
            if gap == " " and not last.isspace() and not text[:1].isspace() or gap.startswith("\n"):
                self.out.append(gap)
        self.out.append(text)


_ROW = "path string, page_no int, text string, kept bigint, dropped bigint, error string"


def read_pages(files: DataFrame) -> DataFrame:
    """path, page_no, text, kept, dropped; a file that can't be read is one row with its error."""

    def rows(batches):
        for b in batches:
            yield from batches_of((r for path, c in zip(b.column(0).to_pylist(), b.column(1), strict=True) for r in pages_of(path, c.as_py() or b"")), [c.split()[0] for c in _ROW.split(", ")], [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()], 256)

    return files.select("path", "content").mapInArrow(rows, _ROW).withColumn("text", tidy("text")).withColumn("garbled", garbled(F.col("kept"), F.col("dropped")))


def pages_of(path: str, content: bytes) -> Iterator[tuple]:
    try:
        if len(content) > MOST_FILE:
            raise ValueError("too large")
        doc, n = Document(content), 0
        for n, (info, resources) in enumerate(doc.pages(), 1):
            page = Page(doc)
            page.run(doc.contents(info), resources)
            yield path, n, "".join(page.out), page.kept, page.dropped, None
        if not n:
            yield path, None, None, None, None, "no pages"
    except (ValueError, RecursionError, EOFError, TypeError) as problem:
        yield path, None, None, None, None, str(problem)


def read_pdf(files: DataFrame) -> DataFrame:
    """path, text, garbled pages and, where there is no text, why: a scan, or fonts that can't be read."""
    pages = within_budget(read_pages(files), "path", "page_no", F.coalesce(F.octet_length("text"), F.lit(0)), MOST_CHARS)
    text = assemble_pages(pages.filter("page_no is not null"), "path")
    facts = pages.groupBy("path").agg(F.sum("dropped").alias("dropped"), F.count_if(F.length("text") >= 8).alias("with_text"), F.count_if("garbled").alias("garbled_pages"), F.max("error").alias("error"))
    why = F.when(F.col("error").isNull() & (F.col("with_text") == 0), F.when(F.col("dropped") >= 32, "fonts that do not say what their letters are").otherwise("a scan: no text")).otherwise(F.col("error"))
    return facts.join(text, "path", "left").select("path", "text", "garbled_pages", why.alias("error"))
