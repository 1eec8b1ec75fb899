"""Fingerprints: Hamming distances, perceptual hashes, histograms and blocks."""

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType


def hamming(first: Column, second: Column) -> Column:
    """C14."""
    return F.bit_count(first.bitwiseXOR(second))


def sign_bits(values: Column) -> Column:
    """A 64-bit fingerprint: bit i is set where value i is positive."""
    return F.aggregate(F.zip_with(values, F.sequence(F.lit(0), F.size(values) - 1), lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def unsigned_hex(bits: Column) -> Column:
    """Zero-padded, so that text order is the order of unsigned numbers."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def dhash(luma: Column) -> Column:
    """C17 on 8 rows of 9 gray values: bit set where a value exceeds its right neighbour, row-major from the lowest bit."""
    def bit(i: Column) -> Column:
        left = (F.floor(i / 8) * 9 + i % 8 + 1).cast("int")
        return F.when(F.element_at(luma, left) > F.element_at(luma, left + 1), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def histogram_distance(first: Column, second: Column) -> Column:
    """Half the L1 distance, over the pixels."""
    return F.aggregate(F.zip_with(first, second, lambda a, b: F.abs(a - b).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b) / 2048.0


def color_histogram(pixels: Column) -> Column:
    """C18 on an array of (r, g, b): counts of 4 x 4 x 4 bins at r * 16 + g * 4 + b."""
    bins = F.transform(pixels, lambda p: (F.floor(p["r"] / 64) * 16 + F.floor(p["g"] / 64) * 4 + F.floor(p["b"] / 64)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.size(F.filter(bins, lambda b: b == k)))


def bytes_to_colors(data: Column) -> Column:
    """Triples of a hex string of RGB bytes."""
    at = lambda i: F.conv(F.substr(data, i, F.lit(2)), 16, 10).cast("int")
    n = F.floor(F.length(data) / 6).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i * 6 + 1).alias("r"), at(i * 6 + 3).alias("g"), at(i * 6 + 5).alias("b")))).otherwise(F.array().cast("array<struct<r:int,g:int,b:int>>"))


def average_difference(first: Column, second: Column, limit: int, min_iterations: int = 1) -> Column:
    """C21 on arrays of (r, g, b): mean sum of differences, truncated, 1 for a trace; limit + 1 as soon as the running mean exceeds the limit."""
    diffs = F.zip_with(first, second, lambda a, b: (F.abs(a["r"] - b["r"]) + F.abs(a["g"] - b["g"]) + F.abs(a["b"] - b["b"])).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def step(acc: Column, d: Column) -> Column:
        total, n = acc["sum"] + d, acc["n"] + 1
        return F.when(acc["stop"], acc).otherwise(F.struct(total.alias("sum"), n.alias("n"), ((total > F.lit(limit) * n) & (n >= min_iterations)).alias("stop")))

    end = F.aggregate(diffs, start, step)
    mean = F.floor(end["sum"] / end["n"])
    value = F.when(end["stop"], limit + 1).when((end["sum"] > 0) & (mean == 0), 1).otherwise(mean).cast("int")
    return F.when((F.size(first) == 0) | (F.size(first) != F.size(second)), F.raise_error(F.lit("blocks differ in number or are empty")).cast("int")).otherwise(value)


#: Blocks that are compared before a difference may end the comparison.
LEAST_BLOCKS = 3


def _comparable(first: Column, second: Column) -> Column:
    return (F.size(first) == F.size(second)) & (F.size(first) > 0)


def block_percentage(orientations: Column, second: Column, threshold: int) -> Column:
    """100 - difference of the first orientation that reaches the threshold, at most 99; null if none does. Blocks that differ in number score 0."""
    score = lambda b: F.when(_comparable(b, second), 100 - average_difference(b, second, 100 - threshold, LEAST_BLOCKS)).otherwise(0)
    first = F.get(F.filter(F.transform(orientations, score), lambda s: s >= threshold), F.lit(0))
    return F.when(first.isNotNull(), F.least(first, F.lit(99)))


def block_similarity(orientations: Column, second: Column) -> Column:
    """(similarity, orientation): 0 .. 100, the best and first over all orientations, compared to the end; 0 where blocks differ in number."""
    score = lambda b: F.when(_comparable(b, second), F.greatest(F.lit(0), 100 - average_difference(b, second, 768, LEAST_BLOCKS))).otherwise(0)
    best = F.array_max(F.transform(orientations, lambda b, i: F.struct(score(b).alias("similarity"), (-i).alias("o"))))
    return F.struct(best["similarity"].alias("similarity"), F.when(best["similarity"] > 0, -best["o"]).otherwise(0).alias("orientation"))


def dimensions_compatible(a: Column, b: Column, scaled: bool, rotated: bool) -> Column:
    """B15."""
    same = (a["w"] == b["w"]) & (a["h"] == b["h"])
    turned = (a["w"] == b["h"]) & (a["h"] == b["w"])
    return F.lit(True) if scaled else (same | turned if rotated else same)


@functools.lru_cache(64)
def _cosines(n: int, k: int) -> np.ndarray:
    i = np.arange(n)
    m = np.cos(np.pi * (2 * i[None, :] + 1) * np.arange(k)[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def dct_phash_of(luma: np.ndarray, size: int = 8) -> int:
    """Signs of the low frequencies against their median without the constant one."""
    g = np.asarray(luma, dtype=np.float64)
    c = (_cosines(g.shape[0], size) @ g @ _cosines(g.shape[1], size).T).ravel()
    c[np.abs(c) <= np.abs(c).max() * 1e-12] = 0
    bits = (c > np.median(c[1:])).astype(object)
    bits[0] = 0
    return int(sum(int(b) << i for i, b in enumerate(bits)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(LongType())
def dct_phash(luma: pd.Series) -> pd.Series:
    """C15, C30 on arrays of rows of gray values."""
    return luma.map(lambda x: None if x is None else _signed(dct_phash_of(np.stack([np.asarray(r, dtype=np.float64) for r in x]))))


def blocks_of(pixels: np.ndarray, n: int) -> np.ndarray:
    """C20: truncated mean colours of n x n cells; remaining pixels at the edges don't count."""
    h, w = pixels.shape[:2]
    bh, bw = max(h // n, 1), max(w // n, 1)
    ys, xs = (np.minimum(np.arange(n) * b, max(d - b, 0)) for b, d in ((bh, h), (bw, w)))
    whole = h >= n and w >= n  # then the cells lie side by side, and nothing is copied
    cells = pixels[: n * bh, : n * bw] if whole else pixels[(ys[:, None] + np.arange(bh)).ravel()][:, (xs[:, None] + np.arange(bw)).ravel()]
    return (cells.reshape(n, bh, n, bw, 3).sum(axis=(1, 3)) // (bh * bw)).reshape(-1, 3)


def orientations_of(grid: np.ndarray) -> list[np.ndarray]:
    """Identity, flips, turns and transposes, in the order in which they are tried."""
    rot = lambda k: np.rot90(grid, k)
    t = grid.swapaxes(0, 1)
    return [grid, grid[:, ::-1], rot(2), grid[::-1], t, rot(3), np.rot90(t, 2), rot(1)]
