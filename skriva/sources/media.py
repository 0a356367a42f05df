"""Pictures and videos as far as their headers and times go; models are callables that the caller gives."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batches_of
from ..functions.spoken import fit_within, moment
from ..functions.text import trim

#: Picture bytes; turns by EXIF orientation; extensions of photographs (fixed values).
MOST_BYTES = 64 << 20
TURNS = {1: "upright", 2: "flip across", 3: "half turn", 4: "flip down", 5: "transpose", 6: "quarter turn right", 7: "transverse", 8: "quarter turn left"}
PHOTOS = ("jpg", "jpeg", "heic", "heif")


def _exif(tiff: bytes) -> dict:
    """orientation, lat and lon of a TIFF header."""
    order = "<" if tiff[:2] == b"II" else ">"
    out: dict = {}

    def entries(at: int):
        n = struct.unpack_from(f"{order}H", tiff, at)[0]
        for i in range(min(n, 512)):
            tag, kind, count = struct.unpack_from(f"{order}HHI", tiff, at + 2 + 12 * i)
            yield tag, kind, count, at + 10 + 12 * i

    def rationals(count: int, at: int) -> list[float]:
        at = struct.unpack_from(f"{order}I", tiff, at)[0]
        pairs = [struct.unpack_from(f"{order}II", tiff, at + 8 * i) for i in range(min(count, 3))]
        return [a / b for a, b in pairs if b]

    def degrees(parts: list[float], ref: bytes) -> float | None:
        return None if not parts else sum(x / 60**i for i, x in enumerate(parts)) * (-1 if ref in (b"S", b"W") else 1)

    gps = None
    for tag, _, _, at in entries(struct.unpack_from(f"{order}I", tiff, 4)[0]):
        if tag == 0x112:
            out["orientation"] = struct.unpack_from(f"{order}H", tiff, at)[0]
        elif tag == 0x8825:
            gps = struct.unpack_from(f"{order}I", tiff, at)[0]
    if gps:
        found = {tag: (count, at) for tag, _, count, at in entries(gps)}
        for name, ref, tag in (("lat", 1, 2), ("lon", 3, 4)):
            if ref in found and tag in found:
                out[name] = degrees(rationals(*found[tag]), tiff[found[ref][1] : found[ref][1] + 1])
    lat, lon = out.get("lat"), out.get("lon")
    if lat is None or lon is None or abs(lat) > 90 or abs(lon) > 180:
        out["lat"] = out["lon"] = None
    return out


def header(data: bytes) -> dict:
    """width, height, orientation, lat, lon of a PNG or JPEG; what isn't known is missing."""
    out: dict = {}
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            out["width"], out["height"] = struct.unpack(">II", data[16:24])
        elif data[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(data) and data[at] == 0xFF:
                kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    out |= _exif(data[at + 10 : at + 2 + size])
                elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    out["height"], out["width"] = struct.unpack(">HH", data[at + 5 : at + 9])
                    break
                elif kind == 0xDA:
                    break
                at += 2 + size
    except struct.error:
        pass
    return out


def read_images(files: DataFrame) -> DataFrame:
    """path, payload (base64), width, height, turn, lat, lon, the size to send, and whether it must be made anew.

    Resizing itself needs a picture library and is left to the caller; a file of unknown kind passes as it is.
    """

    names = ["path", "payload", "width", "height", "orientation", "lat", "lon", "error"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]

    def rows(batches):
        for b in batches:
            out = []
            for path, content, payload, error in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                h = {} if error else header(content.as_py())
                out.append((path, payload, h.get("width"), h.get("height"), h.get("orientation"), h.get("lat"), h.get("lon"), error))
            yield from batches_of(out, names, kinds)

    # a picture that is refused is a row with the reason, and isn't shipped
    error = F.when(F.col("content").isNull(), F.lit("cannot be read")).when(F.length("content") > MOST_BYTES, F.lit("too large"))
    fits = files.select("path", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))
    facts = fits.select("path", "content", F.base64("content").alias("payload"), "error").mapInArrow(rows, "path string, payload string, width int, height int, orientation int, lat double, lon double, error string")
    turn = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TURNS.items() for x in kv]), F.col("orientation")), F.lit("upright"))
    anew = (F.greatest("width", "height") > 2048) | (F.coalesce("orientation", F.lit(1)) != 1)
    return facts.select("path", "width", "height", "lat", "lon", F.when(F.col("error").isNull(), turn).alias("turn"), fit_within(F.col("width"), F.col("height")).alias("send"), F.coalesce(anew, F.lit(False)).alias("anew"), "payload", "error")


def is_photo(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*PHOTOS)


def described(frames: DataFrame, describe: Callable[[list[bytes]], list[str]], column: str = "payload") -> DataFrame:
    """frames with text: what a model says of each, asked for a batch at a time."""

    @F.pandas_udf("string")
    def said(x):
        import pandas as pd

        return pd.Series(describe([bytes(v) for v in x]), dtype="object")

    return frames.withColumn("text", said(F.col(column)))


def video_transcript(frames: DataFrame, by: str = "path") -> DataFrame:
    """by and text: each description under its moment, blank ones left out, in time order."""
    said = frames.filter(F.col("text").rlike(r"(?U)\S")).select(by, "t", F.concat(moment(F.col("t")), F.lit(": "), trim("text")).alias("line"))
    rows = said.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("t", "line"))).alias("all"))
    return rows.select(by, F.array_join(F.transform("all", lambda x: x["line"]), "\n\n").alias("text"))


def narration_request(prompt: Column, facts: Column) -> Column:
    return F.concat(trim(prompt), F.lit("\n\n"), facts)


def narration_usable(narration: Column, source: Column) -> Column:
    """At least 80 characters and a quarter of what was told (fixed values)."""
    n = F.length(trim(narration))
    return (n >= 80) & (n * 4 >= F.length(source))
