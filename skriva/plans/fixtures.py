"""Small files of each kind, built in memory for round trips and tests."""

from __future__ import annotations

import base64
import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def word_file(text: str, body: str | None = None) -> bytes:
    """A document with a paragraph for each line, or with the body given."""
    made = body if body is not None else "".join(f'<w:p><w:pPr><w:t>not said</w:t></w:pPr><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    return zipped({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{made}</w:body></w:document>'})


def slide_xml(title: str | None, lines: list[str], hidden: bool = False, more: str = "") -> str:
    shape = lambda kind, texts: f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type={chr(34)}{kind}{chr(34)}/>" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in texts)}</p:txBody></p:sp>'
    head = shape("title", [title]) if title is not None else ""
    return f'<p:sld {_P}{" show=" + chr(34) + "0" + chr(34) if hidden else ""}><p:cSld><p:spTree>{head}{shape("", lines)}{shape("sldNum", ["7"])}{more}</p:spTree></p:cSld></p:sld>'


def slide_file(slides: list[tuple[str | None, list[str], bool]]) -> bytes:
    """A deck whose list is the reverse of its parts' numbers."""
    n = len(slides)
    parts = {f"ppt/slides/slide{n - i}.xml": slide_xml(*s) for i, s in enumerate(slides)}
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i}"/>' for i in range(n))
    links = "".join(f'<Relationship Id="rId{i}" Type="x/slide" Target="slides/slide{n - i}.xml"/>' for i in range(n))
    return zipped({"ppt/presentation.xml": f"<p:presentation {_P}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": f"<Relationships>{links}</Relationships>", **parts})


def pdf_file(pages: list[str], compress: bool = True) -> bytes:
    """A document with one line of Helvetica for each line of a page; letters of Windows-1252 only."""
    objects: list[bytes] = []
    add = lambda data: objects.append(data) or len(objects)
    font = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    tree = len(objects) + 2 * len(pages) + 1
    kids = []
    for text in pages:
        shown = b"BT /F1 12 Tf 72 720 Td 14 TL " + b" ".join(b"(" + x.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*" for x in text.split("\n")) + b" ET"
        data = zlib.compress(shown) if compress else shown
        stream = add(b"<< /Length %d %s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " if compress else b"") + data + b"\nendstream")
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R /Resources << /Font << /F1 %d 0 R >> >> >>" % (tree, stream, font)))
    add(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids)))
    root = add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree)
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return body + b"trailer << /Root %d 0 R /Size %d >>\n%%%%EOF" % (root, len(objects) + 1)


def run_xml(text: str, properties: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{properties}</w:rPr>" if properties else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def formatted_file(paragraphs: list[list[tuple[str, str]]]) -> bytes:
    """A Word document of runs (text, properties), a list for each paragraph."""
    return word_file("", "".join(f"<w:p>{''.join(run_xml(*r) for r in runs)}</w:p>" for runs in paragraphs))


def picture_xml(alt: str | None) -> str:
    return f'<p:pic><p:nvPicPr><p:cNvPr id="4" name="never said"{f" descr={chr(34)}{escape(alt)}{chr(34)}" if alt is not None else ""}/></p:nvPicPr></p:pic>'


def noted_file(slides: list[tuple[str | None, list[str], str, str | None, bool]]) -> bytes:
    """A deck without a list, so its parts' numbers order it: (title, lines, more shapes, notes, hidden) of each slide."""
    parts: dict[str, str | bytes] = {}
    for i, (title, lines, more, notes, hidden) in enumerate(slides, 1):
        parts[f"ppt/slides/slide{i}.xml"] = slide_xml(title, lines, hidden, more)
        if notes is not None:
            parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = f'<Relationships><Relationship Id="a" Type="x/slideLayout" Target="../l.xml"/><Relationship Id="b" Type="x/notesSlide" Target="../notesSlides/n{i}.xml"/></Relationships>'
            parts[f"ppt/notesSlides/n{i}.xml"] = slide_xml(None, [notes])
    return zipped(dict(reversed(parts.items())))


def _lzw(data: bytes) -> bytes:
    """Nine-bit codes: every byte as itself, the table cleared before it can need a tenth bit."""
    codes = [c for i in range(0, len(data), 200) for c in (256, *data[i : i + 200])] + [257]
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


#: The layers that pdf_variant() knows, by number.
VARIANTS = ("plain", "lzw", "hex", "ascii85", "runs", "png", "tiff", "objects", "cmap", "form", "differences", "later")


def pdf_variant(kind: str, text: str) -> bytes:
    """A page that says a line of ASCII letters, digits and marks in one of the ways of VARIANTS; encrypted if kind is that."""
    shown = b"BT /F1 12 Tf 72 720 Td (" + text.encode().replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj ET"
    font, filters, more, resources, trailer = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b"", [], b"", b""
    data = shown
    if kind == "lzw":
        data, filters = _lzw(shown), b"/Filter /LZWDecode"
    elif kind == "hex":
        data, filters = shown.hex().encode() + b">", b"/Filter [/ASCIIHexDecode]"
    elif kind == "ascii85":
        data, filters = base64.a85encode(zlib.compress(shown), adobe=True), b"/Filter [/ASCII85Decode /FlateDecode]"
    elif kind == "runs":
        data, filters = b"".join(bytes([len(p) - 1]) + p for p in (shown[i : i + 100] for i in range(0, len(shown), 100))) + b"\x80", b"/Filter /RunLengthDecode"
    elif kind in ("png", "tiff"):
        rows = [(shown + b" " * (-len(shown) % 8))[i : i + 8] for i in range(0, len(shown), 8)]
        left = [bytes((r[i] - (r[i - 1] if i else 0)) & 255 for i in range(8)) for r in rows]
        up = [b"\2" + bytes((a - b) & 255 for a, b in zip(r, q, strict=True)) for r, q in zip(rows, [bytes(8), *rows], strict=False)]
        data = zlib.compress(b"".join(left if kind == "tiff" else [b"\1" + x if i % 2 else y for i, (x, y) in enumerate(zip(left, up, strict=True))]))
        filters = b"/Filter /FlateDecode /DecodeParms << /Predictor %d /Columns 8 >>" % (2 if kind == "tiff" else 15)
    elif kind == "cmap":
        codes = {c: i + 1 for i, c in enumerate(dict.fromkeys(text))}
        data = b"BT /F1 12 Tf 72 720 Td <" + b"".join(b"%04x" % codes[c] for c in text) + b"> Tj ET"
        table = b"%d beginbfchar " % len(codes) + b" ".join(b"<%04x> <%04x>" % (i, ord(c)) for c, i in codes.items()) + b" endbfchar"
        more = [b"<< /Length %d >>\nstream\n" % len(table) + table + b"\nendstream", b"<< /Type /Font /Subtype /CIDFontType2 /DW 500 >>"]
        font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 6 0 R /DescendantFonts [7 0 R] >>"
    elif kind == "form":
        more = [b"<< /Type /XObject /Subtype /Form /BBox [0 0 9 9] /Resources << /Font << /F1 1 0 R >> >> /Length %d >>\nstream\n" % len(shown) + shown + b"\nendstream"]
        data, resources = b"q BI /W 2 /H 1 /BPC 8 /CS /G ID (\xff EI Q q /X1 Do Q", b"/XObject << /X1 6 0 R >>"
    elif kind == "differences":
        names = list(dict.fromkeys(text))
        data = b"BT /F1 12 Tf 72 720 Td <" + b"".join(b"%02x" % (names.index(c) + 1) for c in text) + b"> Tj ET"
        font = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /Differences [1 %s] >> >>" % b" ".join(b"/uni%04X" % ord(c) for c in names)
    elif kind == "encrypted":
        trailer = b"/Encrypt 1 0 R "
    stream = lambda d: b"<< /Length %d %s >>\nstream\n" % (len(d), filters) + d + b"\nendstream"
    page = b"<< /Type /Page /Parent 4 0 R /Contents 2 0 R /Resources << /Font << /F1 1 0 R >> %s >> >>" % resources
    objects = [(1, font), (2, stream(data)), (3, page), (4, b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>"), (5, b"<< /Type /Catalog /Pages 4 0 R >>"), *enumerate(more, 6)]
    if kind == "objects":
        packed = [(n, o) for n, o in objects if n != 2]
        at = [sum(len(o) + 1 for _, o in packed[:i]) for i in range(len(packed))]
        head = b" ".join(b"%d %d" % (n, x) for (n, _), x in zip(packed, at, strict=True)) + b"\n"
        inner = zlib.compress(head + b" ".join(o for _, o in packed))
        objects = [(2, stream(data)), (9, b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(packed), len(head), len(inner)) + inner + b"\nendstream")]
    if kind == "later":
        old = b"BT /F1 12 Tf 72 720 Td (superseded) Tj ET"
        objects.insert(0, (2, b"<< /Length %d >>\nstream\n" % len(old) + old + b"\nendstream"))
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects) + b"trailer << /Root 5 0 R %s>>\n%%%%EOF" % trailer


def jpeg_file(width: int, height: int, orientation: int, degrees: int | None) -> bytes:
    """The head of a JPEG whose EXIF block tells an orientation and, with degrees, a place that far south and east."""
    gps = struct.pack("<H", 4) + b"".join(struct.pack("<HHI4s", *e) for e in ((1, 2, 2, b"S\0\0\0"), (2, 5, 3, struct.pack("<I", 120)), (3, 2, 2, b"E\0\0\0"), (4, 5, 3, struct.pack("<I", 144)))) + bytes(4)
    first = struct.pack("<H", 1 if degrees is None else 2) + struct.pack("<HHIHH", 0x112, 3, 1, orientation, 0) + struct.pack("<HHII", 0x8825, 4, 1, 38) + bytes(4)
    tiff = b"II*\0" + struct.pack("<I", 8) + first + gps
    tiff += bytes(120 - len(tiff)) + 2 * struct.pack("<6I", degrees or 0, 1, 30, 1, 36, 1)
    exif = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(10)


def png_file(width: int, height: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", width, height)
