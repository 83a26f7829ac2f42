"""Seeded draws and content hashes that do not depend on a platform's library."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
# Fixed values of the 64-bit Mersenne twister and of FNV-1a with the offset basis in use here.
_N, _M = 312, 156
_A = 0xB5026F5AA96619E9
FNV_BASIS = 1469598103934665603
FNV_PRIME = 1099511628211


class Twister:
    """The 64-bit Mersenne twister (mt19937_64)."""

    def __init__(self, seed: int):
        state = [seed & _MASK]
        for i in range(1, _N):
            state.append((6364136223846793005 * (state[-1] ^ (state[-1] >> 62)) + i) & _MASK)
        self._state, self._at = state, _N

    def _refill(self) -> None:
        s = self._state
        for i in range(_N):
            x = (s[i] & 0xFFFFFFFF80000000) | (s[(i + 1) % _N] & 0x7FFFFFFF)
            s[i] = s[(i + _M) % _N] ^ (x >> 1) ^ (_A if x & 1 else 0)
        self._at = 0

    def next(self) -> int:
        if self._at == _N:
            self._refill()
        x = self._state[self._at]
        self._at += 1
        x ^= (x >> 29) & 0x5555555555555555
        x ^= (x << 17) & 0x71D67FFFEDA60000
        x ^= (x << 37) & 0xFFF7EEE000000000
        return x ^ (x >> 43)

    def below(self, n: int) -> int:
        """An unbiased draw from 0 to n - 1: values above the last whole multiple of n are rejected."""
        if n <= 0:
            raise ValueError("the range must not be empty")
        last = _MASK - ((_MASK % n) + 1) % n
        while (x := self.next()) > last:
            pass
        return x % n


def uniform_ints(n: int, low: int, high: int, seed: int) -> list[int]:
    """n draws from low to high; a shorter list is the beginning of a longer one."""
    if high < low:
        raise ValueError("high is below low")
    twister = Twister(seed)
    return [low + twister.below(high - low + 1) for _ in range(n)]


def seeded_permutation(n: int, seed: int) -> list[int]:
    """Fisher-Yates from the end."""
    twister, out = Twister(seed), list(range(n))
    for i in range(n - 1, 0, -1):
        j = twister.below(i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def unit_hash(ids: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64(id xor seed) / 2^64 for each id."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) ^ np.uint64(seed & _MASK)
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return x.astype(np.float64) / 2.0**64


def fnv1a(data: bytes, state: int = FNV_BASIS) -> int:
    for byte in data:
        state = ((state ^ byte) * FNV_PRIME) & _MASK
    return state


def hex64(value: int) -> str:
    return f"{value:016x}"
