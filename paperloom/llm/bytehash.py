"""Vectorised rolling hashes over bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Hash of any stretch of a byte array in constant time, after one pass over it.

    The hash is a polynomial in ``base`` modulo 2**64 over random byte values. Two
    objects of different seeds are independent, and make a 128-bit hash together.
    """

    def __init__(self, seed: int, fold_case: bool = False) -> None:
        with np.errstate(over="ignore"):
            self.values = mix(np.arange(256, dtype=_U) + _U(seed * 256 + 1))
            if fold_case:
                self.values[65:91] = self.values[97:123]
            base = int(mix(np.array([seed + 977], _U))[0]) | 5
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def reserve(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            for name, b in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, _U(b))
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums s with: stretch [a, b) hashes to (s[b] - s[a]) * down[a]."""
        self.reserve(len(data) + 1)
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (sums[b] - sums[a]) * self.down[a]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of width values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
