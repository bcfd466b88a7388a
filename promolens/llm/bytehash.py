"""Polynomial hashes (modulo 2**64) of byte strings, for all positions of a buffer at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1)."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    have = 1
    step = np.uint64(base)
    with np.errstate(over="ignore"):
        while have < n:
            more = min(have, n - have)
            out[have:have + more] = out[:more] * step
            have += more
            step = step * step
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(33)
    return h


class RangeHash:
    """Hashes of any ranges of a buffer, independent of where the range lies."""

    def __init__(self, block: int) -> None:
        self.up, self.down = powers(BASE, block), powers(BASE_INV, block + 1)

    def load(self, buf: np.ndarray) -> RangeHash:
        if len(buf) > len(self.up):
            self.__init__(len(buf))
        self.prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[:len(buf)], out=self.prefix[1:])
        return self

    def get(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.prefix[end] - self.prefix[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def kmer_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of the k bytes that start at each position (len(buf) - k + 1 values)."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    level, size, done, out = buf.astype(np.uint64) + np.uint64(1), 1, 0, None
    rest = k
    while rest:                       # binary decomposition of k
        if rest & 1:
            part = level[done:done + n]
            out = part.copy() if out is None else out * np.uint64(pow(int(BASE), size, 1 << 64)) + part
            done += size
        rest >>= 1
        if rest:
            m = len(level) - size
            level = level[:m] * np.uint64(pow(int(BASE), size, 1 << 64)) + level[size:size + m]
            size *= 2
    return mix(out)


def sliding_leftmost_min(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values: the position of its smallest value, the leftmost if tied."""
    n = len(h) - w + 1
    val, pos, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < w:
        step = min(size, w - size)
        a, b = val[:len(val) - step], val[step:]
        left = a <= b
        pos = np.where(left, pos[:len(a)], pos[step:])
        val = np.where(left, a, b)
        size += step
    return pos[:n]
