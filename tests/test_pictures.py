import hashlib
import math
import statistics
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions import exif, pixels
from kindred.plans import views
from kindred.plans.registry import QUERIES


def scene(h=48, w=64, seed=1):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 256, (6, 8, 3)), np.ones((h // 6, w // 8, 1), dtype=np.int64))


def test_resampling_keeps_means_and_sizes():
    px = scene()
    assert (pixels.resample(np.full((40, 30), 9), 7, 11) == 9).all()
    box = pixels.resample(px, 6, 8, "box")
    assert (box == px[::8, ::8]).all()
    assert pixels.histogram(px).sum() == 1024


def test_fingerprints_survive_scaling():
    px = scene()
    large = np.kron(px, np.ones((3, 3, 1), dtype=np.int64))
    assert (pixels.phash(px) ^ pixels.phash(large)).bit_count() <= 8
    assert (pixels.dhash(px) ^ pixels.dhash(large)).bit_count() <= 6
    assert pixels.thumbnail_identity(px) == pixels.thumbnail_identity(px.copy()) != pixels.thumbnail_identity(large)


def test_crops():
    framed = np.full((100, 100, 3), 250)
    framed[20:80, 10:90] = scene(60, 80)
    crop, box = pixels.content_crop(framed)
    assert abs(crop.shape[0] - 60) <= 4 and abs(box[0] - 1000) <= 200
    assert pixels.content_crop(np.full((100, 100, 3), 5)) is None
    _, box = pixels.center_crop(framed, 0.5)
    assert box == (2500, 2500, 7500, 7500)
    assert [t[0] for t in pixels.tiles(framed)][:1] == ["center_90"]


def test_blockiness():
    smooth = np.repeat(np.add.outer(np.arange(64), np.arange(64))[..., None], 3, axis=2)
    blocky = np.kron(np.random.default_rng(2).integers(0, 255, (8, 8, 1)), np.ones((8, 8, 3), dtype=np.int64))
    assert pixels.blockiness(smooth) == 0.0 and pixels.blockiness(blocky) > 0.5 and pixels.blockiness(blocky[:8]) == 0.0


def test_image_features_as_a_column(spark):
    px = scene(12, 16).tolist()
    df = spark.createDataFrame([(1, px), (2, None)], "id int, pixels array<array<array<int>>>")
    rows = {r.id: r for r in pixels.image_features(df).collect()}
    assert rows[1].dimensions.w == 16 and len(rows[1].phashes) == 8 and len(rows[1].blocks[0]) == 225 and sum(rows[1].histogram) == 1024
    assert rows[2].phashes is None


class Batches:
    """In place of a table: gives the function that Spark would run over batches."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def picture_batch(grids):
    return pa.RecordBatch.from_arrays([pa.array(range(len(grids)), pa.int64()), pa.array(grids, pa.list_(pa.list_(pa.list_(pa.int32()))))], names=["id", "pixels"])


def test_image_features_of_a_large_batch_in_little_memory(spark):
    grids = [scene(24, 24, seed).tolist() for seed in range(7)]
    batch = picture_batch([None if i % 50 == 49 else grids[i % 7] for i in range(600)])
    run = pixels.image_features(Batches(spark))
    seen = []
    tracemalloc.start()
    for out in run(iter([batch.slice(0, 7)])):  # modules and weights that stay
        first = out.to_pylist()
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    for out in run(iter([batch])):
        seen += zip(out.column("id").to_pylist(), out.column("thumbnail").to_pylist(), out.column("blocks").is_null().to_pylist(), strict=True)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 20e6, peak
    assert seen == [(i, None if i % 50 == 49 else first[i % 7]["thumbnail"], i % 50 == 49) for i in range(600)]


def test_image_features_of_a_part_of_a_batch(spark):
    grids = [scene(24, 24, 1).tolist(), None, scene(6, 40, 2).tolist(), scene(60, 8, 3).tolist()]
    run = pixels.image_features(Batches(spark))
    rows = [r for out in run(iter([picture_batch(grids).slice(1, 3)])) for r in out.to_pylist()]
    assert [r["id"] for r in rows] == [1, 2, 3] and set(rows[0].values()) == {1, None}
    for r, px in zip(rows[1:], grids[2:], strict=True):
        assert r["dimensions"] == {"w": len(px[0]), "h": len(px)} and r["blocks"] == [slow_blocks(x) for x in slow_sides(px)]
    for odd in ([[[1, 2, 3], [1, 2, 3]], [[1, 2, 3]]], [[[1, 2, 3], [1, 2]]], [[[1, 2, 3], None]], [[[1, 2, None]]]):
        with pytest.raises((ValueError, TypeError)):
            list(run(iter([picture_batch([odd])])))


def exif_file(order="<"):
    entry = lambda tag, kind, n, v: struct.pack(order + "HHI", tag, kind, n) + v
    when = b"2020:01:02 03:04:05\0"
    main = struct.pack(order + "H", 3) + entry(0x0112, 3, 1, struct.pack(order + "HH", 6, 0)) + entry(0x9999, 4, 1, struct.pack(order + "I", 7)) + entry(0x8769, 4, 1, struct.pack(order + "I", 50)) + b"\0" * 4
    sub = struct.pack(order + "H", 1) + entry(0x9003, 2, 20, struct.pack(order + "I", 70))
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + main
    tiff = tiff.ljust(50, b"\0") + sub
    return b"\xff\xd8\xff\xe1\x00\xff" + b"Exif\0\0" + tiff.ljust(70, b"\0") + when


def test_exif(spark):
    for order in "<>":
        got = exif.exif_fields(exif_file(order))
        assert got == {"Orientation": "6", "0x9999": "7", "DateTimeOriginal": "2020:01:02 03:04:05"}
    df = spark.createDataFrame([(bytearray(exif_file()),), (bytearray(b"nothing"),), (None,)], "c binary")
    assert sorted(r[0] for r in df.select(exif.exif_timestamp(F.col("c"))).collect()) == ["", "", "2020:01:02 03:04:05"]


# -- plain loops -------------------------------------------------------------------------------


def slow_weights(old, new, kind):
    """For each new place the weight of each old one: a three-lobed Lanczos or a box kernel, as wide as what it shrinks."""
    out = []
    for k in range(new):
        scale, row = max(old / new, 1.0), []
        for i in range(old):
            d = (i + 0.5 - (k + 0.5) * old / new) / scale
            if kind == "box":
                w = 1.0 if -0.5 < d <= 0.5 else 0.0
            else:
                w = 0.0 if abs(d) >= 3 else 1.0 if d == 0 else 3 * math.sin(math.pi * d) * math.sin(math.pi * d / 3) / (math.pi * d) ** 2
            row.append(w)
        out.append([w / sum(row) for w in row])
    return out


def slow_resample(rows, height, width, kind="lanczos"):
    """Of rows of numbers."""
    ys, xs = slow_weights(len(rows), height, kind), slow_weights(len(rows[0]), width, kind)
    value = lambda wy, wx: sum(a * sum(b * v for b, v in zip(wx, row, strict=True) if b) for a, row in zip(wy, rows, strict=True) if a)
    return [[min(255, max(0, math.floor(value(wy, wx) + 0.5))) for wx in xs] for wy in ys]


def slow_gray(px):
    return [[(19595 * r + 38470 * g + 7471 * b + 32768) >> 16 for r, g, b in row] for row in px]


def slow_dct_hash(g):
    h, w = len(g), len(g[0])
    norm = lambda k, n: math.sqrt((1 if k == 0 else 2) / n)
    c = [norm(u, h) * norm(v, w) * sum(g[y][x] * math.cos(math.pi * (2 * y + 1) * u / (2 * h)) * math.cos(math.pi * (2 * x + 1) * v / (2 * w)) for y in range(h) for x in range(w)) for u in range(8) for v in range(8)]
    top = max(map(abs, c))
    c = [0.0 if abs(x) <= top * 1e-12 else x for x in c]
    middle = statistics.median(c[1:])
    bits = sum(1 << i for i, x in enumerate(c) if i and x > middle)
    return bits - (1 << 64) if bits >> 63 else bits


def slow_dhash(px):
    g = slow_resample(slow_gray(px), 8, 9)
    bits = sum(1 << (y * 8 + x) for y in range(8) for x in range(8) if g[y][x] > g[y][x + 1])
    return bits - (1 << 64) if bits >> 63 else bits


def slow_sides(px):
    """Identity, mirrored, half turn, upside down, transposed, turned right, transposed about the other diagonal, turned left."""
    h, w = len(px), len(px[0])
    flip = lambda p: [row[::-1] for row in p]
    across = [[px[y][x] for y in range(h)] for x in range(w)]
    return [px, flip(px), flip(px)[::-1], px[::-1], across, flip(across), flip(across)[::-1], across[::-1]]


def slow_blocks(px, n=15):
    h, w = len(px), len(px[0])
    bh, bw = max(h // n, 1), max(w // n, 1)
    out = []
    for by in range(n):
        for bx in range(n):
            y, x = min(by * bh, max(h - bh, 0)), min(bx * bw, max(w - bw, 0))
            cell = [px[i][j] for i in range(y, y + bh) for j in range(x, x + bw)]
            out.append([sum(p[c] for p in cell) // (bh * bw) for c in range(3)])
    return out


def slow_histogram(px):
    channels = [slow_resample([[p[c] for p in row] for row in px], 32, 32, "box") for c in range(3)]
    out = [0] * 64
    for y in range(32):
        for x in range(32):
            r, g, b = (channels[c][y][x] // 64 for c in range(3))
            out[r * 16 + g * 4 + b] += 1
    return out


def slow_blockiness(px):
    g = slow_gray(px)
    edge = near = n = 0
    for a in (g, [list(c) for c in zip(*g, strict=True)]):
        for row in a:
            for x in range(8, len(row) - 1, 8):
                edge += abs(row[x] - row[x - 1])
                near += (abs(row[x - 1] - row[x - 2]) + abs(row[x + 1] - row[x])) / 2
                n += 1
    excess = edge / n - near / n * 1.15 - 2.0
    return round(min(1.0, excess / 24), 6) if excess > 0 else 0.0


def test_pixel_grids_equal_plain_loops(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in views.table(spark, sf_dir, "embeddings").collect()}
    rows = {r.id: r.pixels for r in views.pixel_grids(spark, sf_dir).collect()}
    assert set(rows) == set(vectors)
    for i in sorted(vectors)[:30]:
        framed = lambda y, x: i % 3 == 0 and not (4 <= y < 20 and 4 <= x < 16)  # noqa: B023, E731
        assert rows[i] == [[[250 if framed(y, x) else int(abs(vectors[i][(y // 4 * 6 + x // 4 * 5 + c * 11) % 64]) * 900) % 256 for c in range(3)] for x in range(20)] for y in range(24)]


def test_pixel_features_equal_plain_loops(spark, sf_dir):
    grids = {r.id: [[list(p) for p in row] for row in r.pixels] for r in views.pixel_grids(spark, sf_dir).collect()}
    rows = {r.id: r for r in QUERIES["pixel_features"](spark, sf_dir).collect()}
    assert set(rows) == set(grids)
    for i in sorted(grids)[:5]:
        px, r = grids[i], rows[i]
        sides = slow_sides(px)
        assert (r.w, r.h) == (20, 24) and r.histogram == slow_histogram(px) and r.jpeg_artifact_score == slow_blockiness(px)
        assert r.phashes == [slow_dct_hash(slow_resample(slow_gray(s), 32, 32)) for s in sides] and r.dhashes == [slow_dhash(s) for s in sides]
        assert [[list(b) for b in side] for side in r.blocks] == [slow_blocks(s) for s in sides]
        assert r.thumbnail == hashlib.sha256(b"thumbnail-v1\x0020x24\x00" + bytes(v for row in px for p in row for v in p)).hexdigest()
        for t in r.tiles:
            x0, y0, x1, y1 = (round(v * n / 10_000) for v, n in zip(t.box, (20, 24, 20, 24), strict=True))
            part = [row[x0:x1] for row in px[y0:y1]]
            assert (t.phash, t.dhash) == (slow_dct_hash(slow_resample(slow_gray(part), 32, 32)), slow_dhash(part))
        assert [t.kind for t in r.tiles] == ["center_90", "center_75", "center_50"] + ["content"] * (i % 3 == 0)


def test_gray_frames_equal_plain_loops(spark, sf_dir):
    grids = {r.id: [[p[0] for p in row[:16]] for row in r.pixels[:16]] for r in views.pixel_grids(spark, sf_dir).collect()}
    rows = {r.id: r.phash for r in QUERIES["gray_frames"](spark, sf_dir).collect()}
    assert set(rows) == set(grids) and all(rows[i] == slow_dct_hash(grids[i]) for i in sorted(grids)[:12])
