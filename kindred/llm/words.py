"""Words, word hashes and shingles of Arrow batches of texts, in numpy over the UTF-8 bytes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
STEP = U(0x9E3779B97F4A7C15)
PLACE = _rng.integers(0, 2**64, 16, dtype=U) | U(1)  # a factor for each place of a shingle
SHORT = _rng.integers(0, 2**64, 16, dtype=U)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at once, so that the 64-bit temporaries stay small.
CHUNK = 1 << 18
#: The bytes that count of eight, where so many are left.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text begins (one more than texts); null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each text's first word (one more than texts)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~SPACE[raw]
    inner = at[(at > 0) & (at < len(raw))]
    joined = solid[:-1] & solid[1:]
    joined[inner - 1] = False
    first, last = solid.copy(), solid
    first[1:] &= ~joined
    last = solid.copy()
    last[:-1] &= ~joined
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def padded(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased, and eight zeros behind them."""
    return np.concatenate([LOWER[raw], np.zeros(8, np.uint8)])


def eights(low: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte of padded() bytes on, as one number each."""
    return np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))


def _blocks(size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of eight bytes of words of these sizes, from block ``least`` on: their word, their place in it, and each word's first block."""
    n = (size + 7) // 8 - least
    first = np.cumsum(n) - n
    word = np.repeat(np.arange(len(size)), n)
    return word, np.arange(len(word)) - first[word] + least, first


def _hashes(low: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    eight = eights(low)
    out = mix(eight[starts] & HEAD[np.minimum(size, 8)])
    long_ = np.flatnonzero(size > 8)
    if len(long_):
        word, k, first = _blocks(size[long_], 1)
        at = 8 * k
        x = eight[starts[long_][word] + at] & HEAD[np.minimum(size[long_][word] - at, 8)]
        out[long_] += np.add.reduceat(mix(x + mix(k.astype(U) * STEP)), first)
    return mix(out + size.astype(U) * STEP)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased: the mixed sum of its blocks of eight bytes, each mixed with its place.

    Words of at most eight bytes never share one with a word of their size; longer ones only by chance.
    """
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        out[i:j] = _hashes(padded(raw[starts[i] : ends[j - 1]]), starts[i:j] - starts[i], ends[i:j] - starts[i:j])
        i = j
    return out


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether words of ``size`` bytes (one at least) at places of the padded() bytes ``a`` and ``b`` are equal."""
    if not len(size):
        return np.zeros(0, dtype=bool)
    word, k, first = _blocks(size, 0)
    at = 8 * k
    differ = (eights(a)[a_at[word] + at] ^ eights(b)[b_at[word] + at]) & HEAD[np.minimum(size[word] - at, 8)]
    return np.bitwise_or.reduceat(differ, first) == 0


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashes of k consecutive words; of fewer words, the one whole sequence; of none, nothing."""
    raw, at = text_bytes(column)
    begin = 0
    while begin < len(at) - 1:  # whole texts, as many as a chunk holds
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + CHUNK, "right")) - 1)
        part = raw[at[begin] : at[end]]
        starts, ends, first = word_spans(part, at[begin : end + 1] - at[begin])
        w = word_hashes(part, starts, ends)
        grams = np.zeros(0, dtype=U)
        if len(w) >= k:
            grams = w[: len(w) - k + 1] * PLACE[0]
            for j in range(1, k):
                grams = grams + w[j : len(w) - k + 1 + j] * PLACE[j]
            grams = mix(grams)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mix((w[a:b] * PLACE[: b - a]).sum(keepdims=True, dtype=U) + SHORT[b - a])
            else:
                yield np.zeros(0, dtype=U)
        begin = end
