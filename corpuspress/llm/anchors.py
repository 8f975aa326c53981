"""Anchors of a text: the minimizers of all its windows.

Of the 50-byte strings that start in a window, the one with the smallest hash
(the leftmost of equals) is the window's anchor.  A window is as long as the
repeats that are looked for, so equal strings of that length have equal anchors
at equal places, whatever surrounds them.
"""

from __future__ import annotations

import numpy as np

from .fingerprints import mixed

GRAM = 50
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLES = _rng.integers(0, 1 << 64, (2, 256), np.uint64)
_BASE = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64) | np.uint64(1)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], np.uint64)
_POWERS: list[list[np.ndarray]] = [[np.ones(1, np.uint64)] * 2, [np.ones(1, np.uint64)] * 2]


def powers(i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[i][0]) < n:
        for j, b in enumerate((_BASE[i], _INVERSE[i])):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _POWERS[i][j] = np.multiply.accumulate(steps)
    return _POWERS[i][0], _POWERS[i][1]


class Rolling:
    """Hashes of any substrings of a buffer (polynomials modulo 2**64 over random byte values, then mixed)."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        up, self.down = powers(kind, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[kind][data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all windows of ``length`` bytes that lie in one text, and where the first and the last window of each start."""
    rolling = Rolling(data)
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, np.zeros(0, np.uint64), none, none
    h = rolling.grams(gram)
    # The upper half of the hash decides, whatever else is in the buffer; then the place.
    low = np.uint64((1 << 32) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = length - gram + 1
    size, least = 1, key
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    last = width - size
    least = np.minimum(least[: len(least) - last], least[last:]) if last else least
    inside = np.zeros(n + 1, np.int64)
    full = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][full], 1)
    np.add.at(inside, offsets[1:][full] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[: len(least)]) > 0)
    least = (least[window] & low).astype(np.int64)
    if not len(least):
        return none, np.zeros(0, np.uint64), none, none
    new = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return least[new], h[least[new]], window[new], window[np.append(new[1:], len(least)) - 1]
