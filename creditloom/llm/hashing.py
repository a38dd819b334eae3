"""Vectorised 64-bit hashes of words and windows inside a task."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Two odd multipliers: together they give 128-bit keys.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


#: Values that are worked on at a time, so that they stay in a core's cache.
BLOCK = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    out = np.array(x, dtype=U64, ndmin=1)
    for at in range(0, len(out), BLOCK):
        v = out[at : at + BLOCK]
        v ^= v >> U64(30)
        v *= U64(0xBF58476D1CE4E5B9)
        v ^= v >> U64(27)
        v *= U64(0x94D049BB133111EB)
        v ^= v >> U64(31)
    return out


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(MULTIPLIERS[0]))


def _powers(mult: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _POWERS.get((mult, inverse))
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        base = pow(mult, -1, 2**64) if inverse else mult
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = _POWERS[(mult, inverse)] = np.cumprod(have, dtype=U64)
    return have


class Rolling:
    """Hashes of any span of a sequence of 64-bit symbols from one prefix sum."""

    def __init__(self, symbols: np.ndarray, mult: int = MULTIPLIERS[0]):
        n = len(symbols)
        self.mult = mult
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(symbols * _powers(mult, n)[:n], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` symbols from each position on."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, dtype=U64)
        out, back = np.empty(n, dtype=U64), _powers(self.mult, n, True)
        for a in range(0, n, BLOCK):
            e = min(n, a + BLOCK)
            out[a:e] = mix((self.sums[a + size : e + size] - self.sums[a:e]) * back[a:e])
        return out

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the symbols from each ``start`` to before its ``end``."""
        raw = (self.sums[end] - self.sums[start]) * _powers(self.mult, len(self.sums), True)[start]
        return mix(raw + (end - start).astype(U64) * U64(MULTIPLIERS[1]))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` neighbours from each position on, by doubling."""
    n = max(0, len(x) - width + 1)
    out = np.empty(n, dtype=x.dtype)
    for at in range(0, n, BLOCK):
        v, have = x[at : min(n, at + BLOCK) + width - 1], 1
        while have < width:
            step = min(have, width - have)
            v = np.minimum(v[: len(v) - step], v[step:])
            have += step
        out[at : at + BLOCK] = v
    return out


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each word ``[^\\x20\\x09-\\x0D]+``.

    ``data`` holds the UTF-8 bytes of all documents, ``offsets`` their borders.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    ink = ~_SPACE[data]
    edge = np.zeros(len(data), dtype=bool)
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    edge[inner] = True
    before = np.concatenate(([False], ink[:-1])) & ~edge
    start = np.flatnonzero(ink & ~before)
    after = np.concatenate((ink[1:] & ~edge[1:], [False]))
    end = np.flatnonzero(ink & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_VALUES[data]).spans(start, end) if len(start) else np.zeros(0, dtype=U64)
