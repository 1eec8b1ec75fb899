"""Simple-8b: a 4-bit selector and as many ids as fit into 60 bits of each 64-bit word."""

import numpy as np

#: Fixed values of the code: ids a word holds and their bits, by selector. Selectors 0 and 1 stand for runs of 240 and 120 ones.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: A word of selector 15 whose 60 bits are all set is an escape: the next word holds one id of up to 64 bits.
ESCAPE = np.uint64((15 << 60) | ((1 << 60) - 1))
_U = np.uint64


_WIDTH = np.array([x.bit_length() for x in range(1 << 16)], dtype=np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    if not values.max() >> _U(16):
        return _WIDTH[values]
    width = np.zeros(len(values), dtype=np.uint8)
    for part in range(4):
        have = (values >> _U(16 * part)) & _U(0xFFFF)
        width = np.where(have > 0, _WIDTH[have] + np.uint8(16 * part), width)
    return width


def _fits(values: np.ndarray) -> np.ndarray:
    """For each place the selector of the fullest word that can begin there, or -1: its ids must all fit and not run past the end.

    Widest ids of 1, 2, 3, ... neighbours come from each other by shifted maxima.
    """
    n = len(values)
    width = _widths(values)
    best = np.full(n, -1, dtype=np.int8)
    best[width <= 60] = 15
    widest, k = width, 1
    least = int(width.min())
    for s in range(14, 1, -1):
        more, bits = int(COUNTS[s]), int(BITS[s])
        if more > n or bits < least:
            break
        while k < more:  # a word twice as wide at most overlaps itself
            step = min(k, more - k)
            widest, k = np.maximum(widest[: n - k - step + 1], widest[step:][: n - k - step + 1]), k + step
        best[: n - more + 1][widest <= bits] = s
    if least <= 1:
        ones = values == _U(1)
        for s in (1, 0):
            more = int(COUNTS[s])
            if more <= n:
                run = np.concatenate([[0], np.cumsum(ones)])
                best[: n - more + 1][run[more:] - run[:-more] == more] = s
    return best


def encode(values: np.ndarray) -> np.ndarray:
    """The 64-bit words of unsigned values; decode() gives the values back."""
    values = np.ascontiguousarray(values, dtype=_U)
    n = len(values)
    if not n:
        return np.zeros(0, _U)
    best = _fits(values)
    best[(best == 15) & (values == _U((1 << 60) - 1))] = -1
    steps = np.where(best < 0, 1, COUNTS[best]).tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += steps[i]
    at = np.array(at)
    s = best[at]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(s < 0)[:-1]])
    words = np.zeros(len(at) + int((s < 0).sum()), dtype=_U)
    for k in range(16):
        own = np.flatnonzero(s == k)
        if not len(own):
            continue
        word = np.full(len(own), _U(k << 60), dtype=_U)
        if k > 1:
            for j in range(int(COUNTS[k])):
                word |= values[at[own] + j] << _U(int(BITS[k]) * j)
        words[place[own]] = word
    out = np.flatnonzero(s < 0)
    words[place[out]] = ESCAPE
    words[place[out] + 1] = values[at[out]]
    return words


def decode(words: np.ndarray) -> np.ndarray:
    """The values of encode()'s words, all words of a selector at once."""
    words = np.ascontiguousarray(words, dtype=_U)
    if not len(words):
        return np.zeros(0, _U)
    raw = np.zeros(len(words), dtype=bool)
    marks = words == ESCAPE
    if marks.any():  # a raw word may look like a mark, so marks are told apart in order
        i, found = 0, np.flatnonzero(marks).tolist()
        for x in found:
            if x >= i:
                raw[x + 1], i = True, x + 2
        marks = marks & ~raw
    s = (words >> _U(60)).astype(np.int64)
    size = np.where(raw, 1, np.where(marks, 0, COUNTS[s]))
    begin = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=_U)
    out[begin[raw]] = words[raw]
    plain = ~(raw | marks)
    for k in range(16):
        own = np.flatnonzero(plain & (s == k))
        if not len(own):
            continue
        mask = _U((1 << int(BITS[k])) - 1)
        for j in range(int(COUNTS[k])):
            out[begin[own] + j] = _U(1) if k < 2 else (words[own] >> _U(int(BITS[k]) * j)) & mask
    return out
