"""EXIF tags of image files."""

import struct
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

# Names of tags, tags of sub-directories, bytes of field types.
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit",
    0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings",
    0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9204: "ExposureBiasValue", 0x9207: "MeteringMode",
    0x9209: "Flash", 0x920A: "FocalLength", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageLength", 0xA402: "ExposureMode", 0xA403: "WhiteBalance",
    0x0001: "GPSLatitudeRef", 0x0002: "GPSLatitude", 0x0003: "GPSLongitudeRef", 0x0004: "GPSLongitude",
}
EXIF, GPS, INTEROP = 0x8769, 0x8825, 0xA005
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
SEARCHED = 12 + 4096


def _directory(data: bytes, at: int, order: str) -> list[tuple[int, str, int | None]]:
    """(tag, value as text, first whole number) of a directory's entries."""
    out = []
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        size = SIZES.get(kind)
        if size is None:
            continue
        start = entry + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        raw = data[start : start + size * count]
        if len(raw) < size * count:
            continue
        if kind == 2:
            out.append((tag, raw.split(b"\0")[0].decode("latin-1").strip(), None))
        elif kind in (5, 10):
            pairs = struct.unpack(order + f"{2 * count}{'i' if kind == 10 else 'I'}", raw)
            out.append((tag, ", ".join(str(Fraction(a, b)) if b else "0" for a, b in zip(pairs[::2], pairs[1::2], strict=True)), None))
        else:
            values = struct.unpack(order + f"{count}{ {1: 'B', 3: 'H', 4: 'I', 6: 'b', 7: 'B', 8: 'h', 9: 'i', 11: 'f', 12: 'd'}[kind]}", raw)
            out.append((tag, ", ".join(map(str, values)), int(values[0]) if values else None))
    return out


def exif_fields(content: bytes) -> dict[str, str]:
    """Tags by name of the first directory and those it points to; the first value of a tag stands. Raises ValueError without EXIF."""
    at = content[:SEARCHED].find(b"Exif\0\0")
    if at < 0:
        raise ValueError("no EXIF header")
    data = content[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("unknown byte order")
    found: dict[str, str] = {}
    todo = [struct.unpack_from(order + "I", data, 4)[0]]
    seen = set()
    while todo:
        here = todo.pop(0)
        if here in seen:
            continue
        seen.add(here)
        for tag, text, number in _directory(data, here, order):
            if tag in (EXIF, GPS, INTEROP):
                todo += [number] if number else []
            else:
                found.setdefault(TAGS.get(tag, f"0x{tag:04X}"), text)
    return found


def _safe(content: bytes | None) -> dict[str, str]:
    try:
        return exif_fields(bytes(content)) if content is not None else {}
    except (ValueError, struct.error):
        return {}


@F.pandas_udf(MapType(StringType(), StringType()))
def exif(content: pd.Series) -> pd.Series:
    """Tags of each file's content, none where it can't be read; their number is the picture's metadata count."""
    return content.map(_safe)


@F.pandas_udf(StringType())
def exif_timestamp(content: pd.Series) -> pd.Series:
    """When a picture was taken, empty where that isn't known."""
    return content.map(lambda c: _safe(c).get("DateTimeOriginal", ""))
