"""Media columns: a Matroska writer for 8-bit samples, and a parser of EBML into packet and cue tables."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.shared import bound_batches, tidy

# Element ids of the Matroska specification.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, TITLE = 0x2AD7B1, 0x4D80, 0x5741, 0x7BA9
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Masters that end where one of these begins when their size is unknown.
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

SAMPLE_RATE = 8000
FRAME = 512
FRAMES_A_BLOCK = 8
CLUSTER_BYTES = 1 << 15


# -- writing ----------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """A size as EBML writes it: the leading bit tells the width; all ones are reserved for 'unknown'."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(id_: int, data: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def uint(id_: int, n: int) -> bytes:
    return element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames behind their lacing head: their number less one, and the sizes of all but the last."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif kind == EBML_LACING and sizes:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1))
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(payload: bytes, at: int, kind: int) -> bytes:
    """A SimpleBlock of track 1, ``at`` milliseconds into its cluster."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    if kind == FIXED and len({len(f) for f in frames}) > 1 or len(frames) == 1:
        kind = EBML_LACING if len(frames) > 1 else NO_LACING
    return element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", at) + bytes([0x80 | kind << 1]) + lace(frames, kind))


def mux(payload: bytes, title: str = "") -> bytes:
    """A Matroska file of one track of unsigned 8-bit samples; it depends on its arguments alone."""
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", SAMPLE_RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    parts = [element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(TITLE, title.encode()) + element(MUXING_APP, b"kindred") + element(WRITING_APP, b"kindred")), element(TRACKS, track)]
    at, cues = sum(map(len, parts)), []
    for c in range(0, len(payload), CLUSTER_BYTES):
        part, step = payload[c : c + CLUSTER_BYTES], FRAME * FRAMES_A_BLOCK
        start = c * 1000 // SAMPLE_RATE
        blocks = [block(part[i : i + step], i * 1000 // SAMPLE_RATE, (FIXED, EBML_LACING, XIPH)[(c + i) // step % 3]) for i in range(0, len(part), step)]
        parts.append(element(CLUSTER, uint(TIMESTAMP, start) + b"".join(blocks)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


# -- reading ----------------------------------------------------------------------------------


def read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int]:
    """A variable-length integer and where it ends; -1 if all its bits are ones (unknown)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut short at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_mark:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int):
    """(id, start of the element, start of its data, end of its data) of the elements in a range; an unknown size ends at the next top element."""
    while at < end:
        begin = at
        id_, at = read_vint(data, at, keep_mark=True)
        size, at = read_vint(data, at)
        if size < 0:
            stop = at
            while stop < end:
                next_id, after = read_vint(data, stop, keep_mark=True)
                if id_ == CLUSTER and next_id in TOP:
                    break
                n, after = read_vint(data, after)
                stop = end if n < 0 and id_ == SEGMENT else after + max(n, 0)
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {id_:X} at byte {begin} runs past its parent")
        yield id_, begin, at, stop
        at = stop


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges (start, size) of a block's frames."""
    if kind == NO_LACING:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError(f"fixed lacing doesn't divide {end - at} bytes by {n}")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if kind == XIPH:
                size = 0
                while True:
                    size, last, at = size + data[at], data[at], at + 1
                    if last < 255:
                        break
            else:
                raw, after = read_vint(data, at)
                size = raw if not k else sizes[-1] + raw - ((1 << 7 * (after - at) - 1) - 1)
                at = after
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing runs past its block")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes, strict=True))


def parse(data: bytes) -> dict:
    """Tables of a Matroska file: ``packets`` (track, timestamp in ms, start, size, lacing, key), ``cues`` (time, track, cluster position), ``clusters``, ``tracks``, ``info``.

    Positions of clusters and cues count from the segment's first data byte, byte ranges of packets
    from the file's first byte. Times are in whole milliseconds, by the segment's TimestampScale
    (a million nanoseconds where it has none). A block of a group is a key frame if the group
    refers to no other block. Elements that aren't known are skipped.
    """
    out: dict = {"packets": [], "cues": [], "clusters": [], "tracks": [], "info": {}}
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    base = 0

    def frames(a: int, b: int, start: int, key: bool | None) -> None:
        """A block's packets; ``key`` is given for blocks of groups, and in the block's own flags otherwise."""
        track, at = read_vint(data, a)
        shift, flags = struct.unpack_from(">hB", data, at)
        kind = flags >> 1 & 3
        for x, n in unlace(data, at + 3, b, kind):
            out["packets"].append((track, start + shift, x, n, kind, bool(flags & 0x80) if key is None else key))

    def walk(a: int, b: int, within: dict | None) -> None:
        nonlocal base
        for id_, begin, at, stop in elements(data, a, b):
            if id_ == SEGMENT:
                base = at
                walk(at, stop, None)
            elif id_ == CLUSTER:
                own = {"time": 0}
                out["clusters"].append((begin - base, stop - begin))
                walk(at, stop, own)
            elif id_ in (TRACK_ENTRY, CUE_POINT):
                own = {}
                walk(at, stop, own)
                out["tracks" if id_ == TRACK_ENTRY else "cues"].append(own if id_ == TRACK_ENTRY else (own.get("time", 0), own.get("track", 0), own.get("cluster", 0)))
            elif id_ == BLOCK_GROUP:
                inner = list(elements(data, at, stop))
                for _, _, x, y in (e for e in inner if e[0] == BLOCK):
                    frames(x, y, within["time"], all(e[0] != REFERENCE_BLOCK for e in inner))
            elif id_ in MASTERS:
                walk(at, stop, within if id_ in (AUDIO, CUE_POSITIONS) else out["info"])
            elif id_ == SIMPLE_BLOCK:
                frames(at, stop, within["time"], None)
            elif within is not None and id_ in _FIELDS:
                name, how = _FIELDS[id_]
                within[name] = number(at, stop) if how == "n" else data[at:stop].decode("utf-8", "replace") if how == "s" else struct.unpack(">d" if stop - at == 8 else ">f", data[at:stop])[0]

    walk(0, len(data), None)
    scale = out["info"].get("scale", 1_000_000)
    if scale != 1_000_000:
        out["packets"] = [(track, t * scale // 1_000_000, *rest) for track, t, *rest in out["packets"]]
        out["cues"] = [(t * scale // 1_000_000, *rest) for t, *rest in out["cues"]]
    return out


_FIELDS = {TIMESTAMP: ("time", "n"), CUE_TIME: ("time", "n"), CUE_TRACK: ("track", "n"), CUE_CLUSTER: ("cluster", "n"), TRACK_NUMBER: ("number", "n"), TRACK_TYPE: ("type", "n"), CODEC_ID: ("codec", "s"), SAMPLING: ("rate", "f"), CHANNELS: ("channels", "n"), BIT_DEPTH: ("bits", "n"), TIMESTAMP_SCALE: ("scale", "n"), TITLE: ("title", "s"), DOC_TYPE: ("doc_type", "s")}


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, filled with zeros to a positive multiple of 64, and their number without the filling."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def digest(media: bytes) -> dict:
    """What is read back of a stored file: its payload by its packets' byte ranges, and features of packets and samples."""
    t = parse(media)
    payload = b"".join(media[a : a + n] for _, _, a, n, _, _ in t["packets"])
    x = np.frombuffer(payload, np.uint8)
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    lacings = "/".join(str(sum(1 for p in t["packets"] if p[4] == k)) for k in range(4))
    sought = all(c in {a for a, _ in t["clusters"]} for _, _, c in t["cues"])
    rms = float(np.sqrt(np.dot(x.astype(np.float64) - 128, x.astype(np.float64) - 128) / len(x)))
    feature = f"packets={len(t['packets'])};clusters={len(t['clusters'])};cues={len(t['cues'])}{'' if sought else '!'};lacing={lacings};end_ms={t['packets'][-1][1]};mean={x.mean():.3f};rms={rms:.3f};crossings={turns}"
    return {"n_bytes": int(t["info"]["title"]), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature}


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(batches):
    for batch in batches:
        media = []
        for text in batch.column(1).to_pylist():
            payload, n = payload_of(text)
            media.append(mux(payload, str(n)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])


def _digests(batches):
    for batch in batches:
        rows = [digest(m) for m in batch.column(1).to_pylist()]
        names = [c.split()[0] for c in SCHEMA.split(", ")[1:]]
        yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[c] for r in rows], pa.string() if c in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for c in names], names=["doc_id", *names])


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of every row of ``docs`` (doc_id, text, any more columns): each whole text as samples of a Matroska file.

    Null texts are empty; an empty text is 64 zero samples. Equal texts make equal files. An empty
    table gives no rows.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_stored), "doc_id long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """What media_column()'s files hold, from their packets; a file that isn't Matroska fails the job."""
    return media.select("doc_id", "media").mapInArrow(tidy(_digests), SCHEMA)


def _packets(batches):
    for batch in batches:
        rows = [(doc, *p) for doc, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in parse(m)["packets"]]
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "track", "timestamp_ms", "start", "size", "lacing", "key"])


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each packet of each file: track, timestamp, byte range in the file, lacing, key flag."""
    return media.select("doc_id", "media").mapInArrow(tidy(_packets), "doc_id long, track int, timestamp_ms long, start long, size long, lacing int, key boolean")
