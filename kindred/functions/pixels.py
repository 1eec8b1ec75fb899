"""Features of decoded pictures, given as rows of (r, g, b), in numpy."""

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.functions.bits import _signed, blocks_of, dct_phash_of, orientations_of
from kindred.shared import bound_batches, tidy

#: Crops whose fingerprints find cut pictures, and the scale of their boxes.
CENTERS, BOX_SCALE = (("center_90", 0.90), ("center_75", 0.75), ("center_50", 0.50)), 10_000
#: Channels may differ from the background by so much.
BACKGROUND = 16
MOST_SAMPLES = 200_000
#: A Python worker holds the features of so many pictures, and the pixels of one.
PIECE = 64
#: Weights of up to so many numbers are kept for the next picture of the size.
KEPT_WEIGHTS = 1 << 13


def gray(px: np.ndarray) -> np.ndarray:
    """Luma by the weights of ITU-R 601, in whole numbers."""
    p = px.astype(np.int64)
    return (p[..., 0] * 19595 + p[..., 1] * 38470 + p[..., 2] * 7471 + 0x8000) >> 16


#: By kind: a kernel, and where it ends.
KERNELS = {"lanczos": (lambda x: np.sinc(x) * np.sinc(x / 3), 3.0), "box": (lambda x: ((x > -0.5) & (x <= 0.5)).astype(float), 1.0)}


def _weights(old: int, new: int, kind: str) -> np.ndarray:
    return _kept_weights(old, new, kind) if old * new <= KEPT_WEIGHTS else _made_weights(old, new, kind)


def _made_weights(old: int, new: int, kind: str) -> np.ndarray:
    kernel, reach = KERNELS[kind]
    scale = max(old / new, 1.0)
    center = (np.arange(new) + 0.5) * old / new
    w = kernel((np.arange(old)[None, :] + 0.5 - center[:, None]) / scale)
    w[np.abs(np.arange(old)[None, :] + 0.5 - center[:, None]) >= reach * scale] = 0
    return w / w.sum(axis=1, keepdims=True)


_kept_weights = functools.lru_cache(256)(_made_weights)


def resample(a: np.ndarray, height: int, width: int, kind: str = "lanczos") -> np.ndarray:
    """Separable resampling by a three-lobed Lanczos or a box kernel, rounded to whole numbers in 0 .. 255."""
    rows, cols = _weights(a.shape[0], height, kind), _weights(a.shape[1], width, kind)
    if a.ndim == 2:
        out = np.dot(rows, np.dot(cols, a.astype(float).T).T)
    else:
        out = np.tensordot(rows, np.moveaxis(np.tensordot(cols, a.astype(float), axes=(1, 1)), 0, 1), axes=(1, 0))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.int64)


def phash(px: np.ndarray) -> int:
    """C16."""
    return _phash(gray(px))


def _phash(luma: np.ndarray) -> int:
    return dct_phash_of(resample(luma, 32, 32))


def dhash(px: np.ndarray) -> int:
    """C17."""
    return _dhash(gray(px))


def _dhash(luma: np.ndarray) -> int:
    g = resample(luma, 8, 9)
    return int.from_bytes(np.packbits(g[:, :-1] > g[:, 1:], bitorder="little").tobytes(), "little")


def histogram(px: np.ndarray) -> np.ndarray:
    """4 x 4 x 4 bins of 1024 pixels."""
    q = resample(px, 32, 32, "box") // 64
    return np.bincount((q[..., 0] * 16 + q[..., 1] * 4 + q[..., 2]).ravel(), minlength=64)


def _box(left: float, top: float, right: float, bottom: float, width: int, height: int) -> tuple[int, int, int, int]:
    return tuple(round(v * BOX_SCALE / n) for v, n in ((left, width), (top, height), (right, width), (bottom, height)))


def center_crop(px: np.ndarray, ratio: float):
    """The middle of a picture, and its box."""
    h, w = px.shape[:2]
    ch, cw = max(2, round(h * ratio)), max(2, round(w * ratio))
    top, left = max(0, (h - ch) // 2), max(0, (w - cw) // 2)
    return px[top : top + ch, left : left + cw], _box(left, top, left + cw, top + ch, w, h)


def content_crop(px: np.ndarray):
    """What differs from the corners' median colour, unless that is nearly all or less than a quarter; else nothing."""
    h, w = px.shape[:2]
    shrink = min(1.0, 64 / max(h, w))
    sh, sw = max(1, round(h * shrink)), max(1, round(w * shrink))
    if sh < 8 or sw < 8:
        return None
    small = resample(px, sh, sw, "box")
    corners = np.sort(np.stack([small[0, 0], small[0, -1], small[-1, 0], small[-1, -1]]), axis=0)
    ys, xs = np.nonzero((np.abs(small - corners[2]) > BACKGROUND).any(axis=2))
    if not len(xs):
        return None
    left, right, top, bottom = xs.min(), xs.max() + 1, ys.min(), ys.max() + 1
    if (left < 2 and top < 2 and right > sw - 2 and bottom > sh - 2) or (right - left) * (bottom - top) < sw * sh // 4:
        return None
    fx, fy = w / sw, h / sh
    a, b, c, d = math.floor(left * fx), math.floor(top * fy), min(w, math.ceil(right * fx)), min(h, math.ceil(bottom * fy))
    return (px[b:d, a:c], _box(a, b, c, d, w, h)) if c - a >= 2 and d - b >= 2 else None


def tiles(px: np.ndarray) -> list[tuple]:
    """(kind, pHash, dHash, box) of crops, each pair of hashes once."""
    found, out = set(), []
    for kind, crop in [(k, center_crop(px, r)) for k, r in CENTERS] + [("content", content_crop(px))]:
        if crop is not None:
            luma = gray(crop[0])
            pair = (_phash(luma), _dhash(luma))
            if pair not in found:
                found.add(pair)
                out.append((kind, _signed(pair[0]), _signed(pair[1]), list(crop[1])))
    return out


def blockiness(px: np.ndarray) -> float:
    """How much edges of 8 x 8 blocks stand out against their neighbourhood, 0 .. 1; 0 for small pictures."""
    g = gray(px)
    h, w = g.shape
    if h < 16 or w < 16:
        return 0.0
    step = max(1, math.ceil(((w - 1) // 8 * h + (h - 1) // 8 * w) / MOST_SAMPLES))
    edge, near, n = 0.0, 0.0, 0
    for a in (g, g.T):
        at = np.arange(8, a.shape[1] - 1, 8)
        rows = a[::step]
        edge += np.abs(rows[:, at] - rows[:, at - 1]).sum()
        near += (np.abs(rows[:, at - 1] - rows[:, at - 2]) + np.abs(rows[:, at + 1] - rows[:, at])).sum() / 2
        n += len(rows) * len(at)
    excess = edge / n - near / n * 1.15 - 2.0 if n >= 16 else 0.0
    return round(min(1.0, excess / 24.0), 6) if excess > 0 else 0.0


def thumbnail_identity(px: np.ndarray) -> str:
    """SHA-256 of a version, the size and the pixels of the picture fitted into 256 x 256."""
    h, w = px.shape[:2]
    f = min(1.0, 256 / max(h, w))
    t = px if f == 1.0 else resample(px, max(1, round(h * f)), max(1, round(w * f)))
    return hashlib.sha256(f"thumbnail-v1\0{t.shape[1]}x{t.shape[0]}\0".encode() + t.astype(np.uint8).tobytes()).hexdigest()


#: Blocks a side.
BLOCKS = 15
FEATURES = "dimensions struct<w:int,h:int>, phashes array<long>, dhashes array<long>, blocks array<array<array<int>>>, histogram array<int>, tiles array<struct<kind:string,phash:long,dhash:long,box:array<int>>>, jpeg_artifact_score double, thumbnail string"


def features(px: np.ndarray) -> dict:
    """All features of one picture, fingerprints and blocks in eight orientations."""
    sides = orientations_of(gray(px))
    return {
        "dimensions": {"w": px.shape[1], "h": px.shape[0]},
        "phashes": [_signed(_phash(s)) for s in sides],
        "dhashes": [_signed(_dhash(s)) for s in sides],
        "blocks": np.array([blocks_of(s, BLOCKS) for s in orientations_of(px)]),
        "histogram": histogram(px).tolist(),
        "tiles": [dict(zip(("kind", "phash", "dhash", "box"), t, strict=True)) for t in tiles(px)],
        "jpeg_artifact_score": blockiness(px),
        "thumbnail": thumbnail_identity(px),
    }


def grid(pixels: pa.ListScalar) -> np.ndarray | None:
    """The pixels of one picture, without making Python numbers of them."""
    if not pixels.is_valid:
        return None
    rows = pixels.values
    cells = rows.flatten()
    values = cells.flatten()
    h, n = len(rows), len(cells)
    if h and n and len(values) and not rows.null_count + cells.null_count + values.null_count:
        shape = (h, n // h, len(values) // n)
        if (np.asarray(rows.value_lengths()) == shape[1]).all() and (np.asarray(cells.value_lengths()) == shape[2]).all():
            return values.to_numpy().astype(np.int64).reshape(shape)
    return np.array(pixels.as_py(), dtype=np.int64)  # which says what is wrong


def _block_lists(blocks: list[np.ndarray | None]) -> pa.Array:
    """Lists of eight orientations' blocks; null where there are none."""
    full = [x.ravel() for x in blocks if x is not None]
    flat = pa.array(np.concatenate(full) if full else [], pa.int32())
    steps = lambda n, by: pa.array(np.arange(0, n + 1, by), pa.int32())
    blocks_flat = pa.ListArray.from_arrays(steps(len(flat), 3), flat)
    sides = pa.ListArray.from_arrays(steps(len(blocks_flat), BLOCKS * BLOCKS), blocks_flat)
    ends = np.cumsum([0, *[8 * (x is not None) for x in blocks]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([*[x is None for x in blocks], False])), sides)


def image_features(pictures: DataFrame) -> DataFrame:
    """A10 behind a decoder: (id, features) of pictures (id, pixels); null pixels give nulls.

    A picture's features are some 180 KB of Python objects, so they go out PIECE by PIECE, whatever the size of a batch.
    """
    ints = pa.list_(pa.int32())
    kinds = {
        "dimensions": pa.struct([("w", pa.int32()), ("h", pa.int32())]), "phashes": pa.list_(pa.int64()), "dhashes": pa.list_(pa.int64()), "blocks": None, "histogram": ints,
        "tiles": pa.list_(pa.struct([("kind", pa.string()), ("phash", pa.int64()), ("dhash", pa.int64()), ("box", ints)])), "jpeg_artifact_score": pa.float64(), "thumbnail": pa.string(),
    }

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, PIECE):
                piece = b.slice(at, PIECE)
                rows = [{} if px is None else features(px) for px in map(grid, piece.column(1))]
                made = {k: [r.get(k) for r in rows] for k in kinds}
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(made[k], t) if t else _block_lists(made[k]) for k, t in kinds.items()]], names=["id", *kinds])

    bound_batches(pictures.sparkSession)
    return pictures.select(F.col("id").cast("long").alias("id"), F.col("pixels").cast("array<array<array<int>>>").alias("pixels")).mapInArrow(tidy(run), f"id long, {FEATURES}")
