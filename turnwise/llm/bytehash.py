"""Vectorised hashes over the bytes of many texts at once (numpy, no per-character Python).

* ``gear``: gear hash of the last ``GEAR_WINDOW`` bytes at every byte, by doubling.
* ``Spans``: 64-bit digests of any byte ranges from one running polynomial sum, so that equal byte
  strings have equal digests wherever they stand.
* ``words``: digests and positions of the white-space separated words.
"""

from __future__ import annotations

import numpy as np

GEAR_WINDOW = 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_GEAR = (_BYTE >> np.uint64(32)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """At byte i: sum of ``table[data[i-k]] << k`` over the last GEAR_WINDOW bytes (uint32)."""
    h = _GEAR[data]
    k = 1
    while k < GEAR_WINDOW:
        if len(h) > k:
            older = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += older
        k *= 2
    return h


class Spans:
    """Digests of byte ranges of ``data``."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Spans._up) < n:
            size = max(n, 1 << 16)
            for name, base in (("_up", _BASE), ("_down", _BASE_INV)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(Spans, name, np.multiply.accumulate(powers))
        self._sum = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * Spans._up[:n - 1], out=self._sum[1:])

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sum[end] - self._sum[start]) * Spans._down[start]
        return mix(raw ^ (np.asarray(end - start).astype(np.uint64) << np.uint64(40)))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of the first word of each row (rows + 1 numbers)."""
    space = _SPACE[data]
    edge = np.ones(len(data), bool)  # byte begins a word if the byte before is space or in another row
    edge[1:] = space[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    edge[heads] = True
    start = np.flatnonzero(edge & ~space)
    tail = np.ones(len(data), bool)
    tail[:-1] = space[1:]
    tail[heads[heads > 0] - 1] = True
    end = np.flatnonzero(tail & ~space) + 1
    return start, end, np.searchsorted(start, off)
