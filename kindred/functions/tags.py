"""Tags of audio files: ID3v1, ID3v2 and FLAC comments."""

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

# Frames and comment names of the tags that scans compare.
FRAMES = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TCON": "genre", "TYER": "year", "TDRC": "year", "TRCK": "track", "COMM": "comment"}
COMMENTS = {"title": "title", "artist": "artist", "album": "album", "genre": "genre", "date": "year", "tracknumber": "track", "comment": "comment", "description": "comment"}
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    version, end = data[3], min(len(data), 10 + _syncsafe(data[6:10]))
    at = 10
    while at + 10 <= end and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode("latin-1")
        size = _syncsafe(data[at + 4 : at + 8]) if version >= 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 10 : at + 10 + size]
        if name in FRAMES and body:
            text = body[1:]
            if name == "COMM":  # a language and a description stand before the text
                text = text[3:]
                gap = b"\0\0" if body[0] in (1, 2) else b"\0"
                text = text.split(gap, 1)[-1].lstrip(b"\0")
            values = text.decode(ENCODINGS[min(body[0], 3)], "replace").strip("\0").split("\0")
            out.setdefault(FRAMES[name], []).extend(v.lstrip("﻿") for v in values if v)
        at += 10 + size
    return out


def _id3v1(tail: bytes) -> dict[str, list[str]]:
    cut = lambda a, b: tail[a:b].split(b"\0")[0].decode("latin-1").strip()
    found = {"title": cut(3, 33), "artist": cut(33, 63), "album": cut(63, 93), "year": cut(93, 97), "comment": cut(97, 127)}
    if tail[125] == 0 and tail[126]:
        found["track"] = str(tail[126])
    return {k: [v] for k, v in found.items() if v}


def _flac(data: bytes) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    at, last = 4, False
    while not last and at + 4 <= len(data):
        last, kind, size = data[at] & 0x80, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 4:
            block = data[at + 4 : at + 4 + size]
            p = 4 + struct.unpack_from("<I", block)[0]
            (n,) = struct.unpack_from("<I", block, p)
            p += 4
            for _ in range(n):
                (k,) = struct.unpack_from("<I", block, p)
                name, _, value = block[p + 4 : p + 4 + k].decode("utf-8", "replace").partition("=")
                p += 4 + k
                if name.lower() in COMMENTS:
                    out.setdefault(COMMENTS[name.lower()], []).append(value)
        at += 4 + size
    return out


def audio_tags(content: bytes) -> dict[str, str]:
    """Tags by name: several values joined by ", ", of tracks the first; none of a file without."""
    if content[:3] == b"ID3":
        found = _id3v2(content)
    elif content[:4] == b"fLaC":
        found = _flac(content)
    elif len(content) >= 128 and content[-128:-125] == b"TAG":
        found = _id3v1(content[-128:])
    else:
        found = {}
    return {k: v[0] if k == "track" else ", ".join(v) for k, v in found.items() if v}


def _safe(content) -> dict[str, str]:
    try:
        return audio_tags(bytes(content)) if content is not None else {}
    except (struct.error, IndexError):
        return {}


@F.pandas_udf(MapType(StringType(), StringType()))
def tags(content: pd.Series) -> pd.Series:
    """A9 of each file's content; a file that can't be read has none."""
    return content.map(_safe)
