"""64-bit hashes of many runs of numbers at once, as arrays."""

from __future__ import annotations

import numpy as np

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BASE = 0x9E3779B97F4A7C13
_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    h = (h ^ (h >> np.uint64(31))) * M2
    return h ^ (h >> np.uint64(29))


def numbers(n: int) -> np.ndarray:
    """n fixed numbers that look random."""
    return mixed(mixed(np.arange(1, n + 1, dtype="u8") * M1))


def _powers_of(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, 2, ... modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        p = np.full(max(1 << 20, n), np.uint64(base))
        p[0] = 1
        known = _powers[base] = np.multiply.accumulate(p)
    return known[:n]


def run_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs values[first[i]] to values[last[i]]: polynomials over their values, made from
    sums over all of them. values is overwritten."""
    n = len(values)
    values *= _powers_of(BASE, n)
    np.cumsum(values, out=values)
    h = values[last]
    inner = first > 0
    h[inner] -= values[first[inner] - 1]
    h *= _powers_of(pow(BASE, -1, 1 << 64), n)[first]
    return mixed((h + (last - first).astype("u8")) * M1)


class Places:
    """Values by 64-bit hash in tables of fixed size: what takes a place drives out what had it before."""

    def __init__(self, size: int, kind: str):
        self.keys, self.values, self.mask = np.zeros(size, "u8"), np.zeros(size, kind), np.uint64(size - 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and their values."""
        at = (h & self.mask).astype("i8")
        return self.keys[at] == h, self.values[at]

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        at = (h & self.mask).astype("i8")
        self.keys[at], self.values[at] = h, values

    def clear(self) -> None:
        self.keys[:] = 0
