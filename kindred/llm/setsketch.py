"""SetSketch: exponentially spaced truncated minima, and the likelihood of a similarity given two of them."""

import numpy as np

#: Registers; BANDS bands of ROWS registers. A pair at similarity 0.75 shares no band with a chance of (1 - 0.75**4)**32 = 5e-6.
REGISTERS, BANDS, ROWS = 128, 32, 4
#: The spacing b of the registers and their largest value q + 1.
BASE, TOP = 1.01, 6000
_rng = np.random.Generator(np.random.PCG64(77))
FACTOR = (_rng.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1))[:, None]
SHIFT = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]


def minima(hashes: np.ndarray) -> np.ndarray:
    """For each register the smallest of its 32-bit values over the set; of sets, the element-wise minimum is their union's."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[None, i : i + 1024] * FACTOR + SHIFT).min(axis=1), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """floor(1 - log_b(x)) of the exponential value x that belongs to each minimum, truncated to 0 .. TOP."""
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)) + 700, 0, TOP).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Each band's four 16-bit registers as one 64-bit number: equal if and only if the registers are."""
    return np.ascontiguousarray(regs, dtype="<u2").view("<i8")


#: Bits of each register that are laid out in planes, for comparisons inside joins.
PLANES = 4


def planes(regs: np.ndarray) -> np.ndarray:
    """The lowest PLANES bits of all registers as 64-bit words: word 2 p + w has bit p of registers 64 w .. 64 w + 63."""
    bits = np.stack([(regs >> np.uint16(p)) & np.uint16(1) for p in range(PLANES)]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def least_equal(least: float, sigmas: float = 6.0) -> int:
    """Of registers that are compared by their planes, how many agree at similarity ``least``, less six standard deviations."""
    q = least + (1.0 - least) / 2**PLANES
    return int(REGISTERS * q - sigmas * (REGISTERS * q * (1.0 - q)) ** 0.5)


def log_likelihood(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of similarity j, where of two sketches' registers ``more`` are larger in the first, ``less`` smaller."""
    u = na / (na + nb)
    v = 1.0 - u
    p = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)
    up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    return more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.maximum(1.0 - up - down, 1e-12))


def plausible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, margin: float = 18.0) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity of each pair, and whether similarity ``least`` or more can't be ruled out.

    It is ruled out where sizes forbid it or its likelihood is less by a factor of exp(margin),
    about six standard deviations; what remains is to be verified on full sets.
    """
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    na, nb = na.astype(np.float64), nb.astype(np.float64)
    high = np.minimum(na, nb) / np.maximum(na, nb)
    grid = np.linspace(0.0, 1.0, 65)[:, None] * high[None, :]
    each = log_likelihood(more[None, :], less[None, :], na[None, :], nb[None, :], grid)
    best = grid[each.argmax(axis=0), np.arange(len(high))]
    at = log_likelihood(more, less, na, nb, np.minimum(least, high))
    return best, (high >= least - 1e-12) & ((best >= least) | (each.max(axis=0) - at <= margin))
