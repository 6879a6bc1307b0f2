"""Content-defined anchors: equal 100-byte strings always get the same anchor at the same place in them.

The 69 32-byte grams of a 100-byte window are hashed, and the smallest hash (leftmost of equals) is its
anchor. The choice depends on the window's bytes alone, so that windows with equal bytes share it, and all
windows with one anchor occurrence are consecutive.
"""

from __future__ import annotations

import numpy as np

from paperslip.llm.text_arrays import mix

GRAM = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POS_BITS = 24
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_known: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ...; kept for the next block up to 4 M entries."""
    p = _known.get(int(base))
    if p is None or len(p) < n:
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        p = np.cumprod(p, dtype=np.uint64)
        if n <= 4 << 20:
            _known[int(base)] = p
    return p[:n]


class Rolling:
    """Hashes of any byte range of one array, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SYMBOL[data] * _powers(_BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.inverse = _powers(_INVERSE, n + 1)

    def grams(self, size: int) -> np.ndarray:
        """The hash of every `size` consecutive bytes."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])

    def ranges(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64))


def anchors(data: np.ndarray, ends: np.ndarray, window: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """(row, position, first, last, hash, rolling) of each anchor occurrence of the texts.

    `first` and `last` are the starts of the windows that it stands for; all positions are places in `data`.
    """
    rolling = Rolling(data)
    hashes = rolling.grams(GRAM)
    none = np.zeros(0, np.int64)
    width = window - GRAM + 1
    if len(data) < window or len(data) >= 1 << _POS_BITS and len(ends) > 2:
        if len(data) < window:
            return none, none, none, none, np.zeros(0, np.uint64), rolling
        raise ValueError("a block of several texts is below 16 MB")
    parts = []
    step = (1 << _POS_BITS) - window
    for at in range(0, len(hashes) - width + 1, step):
        own = hashes[at : at + step + width - 1]
        low = own >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS) | np.arange(len(own), dtype=np.uint64)
        size = 1
        while size < width:
            by = min(size, width - size)
            low = np.minimum(low[:-by], low[by:])
            size += by
        parts.append((low & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64) + at)
    anchor = np.concatenate(parts)
    # windows that cross from one text to the next do not count
    inside = np.ones(len(anchor), bool)
    for end in ends[1:-1].tolist():
        inside[max(0, end - window + 1) : end] = False
    edge = np.ones(len(anchor) + 1, bool)
    edge[1:-1] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    cut = np.flatnonzero(edge)
    first, last = cut[:-1], cut[1:] - 1
    first, last = first[inside[first]], last[inside[first]]
    return np.searchsorted(ends, first, "right") - 1, anchor[first], first, last, hashes[anchor[first]], rolling
