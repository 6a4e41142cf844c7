"""Prefix polynomials modulo 2^64: the hash of any stretch of numbers from two entries."""

from __future__ import annotations

import numpy as np


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            for name, value in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, value, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_POWERS: dict[int, Powers] = {}


def _powers(base: int, n: int) -> Powers:
    own = _POWERS.setdefault(base, Powers(base))
    own.grow(n)
    return own


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix polynomial: entry i is the sum of value k times base^k over all k below i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values) + 1).up[: len(values)], out=out[1:])
    return out


def cut(polynomial: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of the values from start to end, wherever they stand."""
    return (polynomial[end] - polynomial[start]) * _powers(base, len(polynomial)).down[start]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
