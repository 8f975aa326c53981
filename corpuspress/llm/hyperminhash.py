"""HyperMinHash registers of shingle sets, in numpy.

One 64-bit hash a shingle: seven bits choose a register, and of the smallest
rest in each register only the number of leading zeros and ten mantissa bits are
kept (16 bits).  Registers that no shingle chose borrow from others along a
probe sequence of their own, so that short texts fill all registers and two
registers agree with the probability of the sets' Jaccard similarity.  A bit for
each register says whether it was chosen; only those count in an estimate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import common
from .fingerprints import mixed, shingle_hashes

REGISTERS, MANTISSA = 128, 10
BAND_ROWS = 4
BANDS = REGISTERS // BAND_ROWS
WIDTH = 2 * REGISTERS + REGISTERS // 8
#: Chance that two unrelated registers agree, for this mantissa (Yu and Weber's expected collisions).
COLLISION = 0.169919487159739 / (1 << MANTISSA)


def lowered(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def shingle_sets(column: pa.Array, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """n + 1 offsets and the sorted distinct shingle hashes of each text (A-Z folded)."""
    data, offsets = common.text_buffer(column)
    words = common.Words(data, offsets)
    row, h = shingle_hashes(words, width, lowered(data))
    order = np.lexsort((h, row)) if len(offsets) > 2 else np.argsort(h)
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    return np.searchsorted(row, np.arange(len(offsets))), h


def set_keys(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set (with its size): equal sets have equal keys."""
    out = []
    for salt in (np.uint64(0), np.uint64(0xD6E8FEB86659FD93)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mixed(h ^ salt) if salt else h, out=total[1:])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def registers(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x REGISTERS unsigned 16-bit registers, zeros for an empty set, and which of them were chosen."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    h = mixed(h ^ np.uint64(0xA0761D6478BD642F))
    cell = row * REGISTERS + (h >> np.uint64(57)).astype(np.int64)
    low = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    order = np.argsort(cell, kind="stable")
    c, v = cell[order], h[order] & np.uint64((1 << 57) - 1)
    if len(c):
        start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        low[c[start]] = np.minimum.reduceat(v, start)
    filled = (low != np.iinfo(np.uint64).max).reshape(n, REGISTERS)
    part, power = np.frexp(((low & np.uint64((1 << 57) - 1)) >> np.uint64(4)).astype(float))
    zeros = 53 - power
    mantissa = np.where(part > 0, (part * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out = ((zeros << MANTISSA) + mantissa + 1).astype(np.uint16).reshape(n, REGISTERS)
    out[~filled] = 0
    some = filled.any(1)
    empty = np.argwhere(~filled & some[:, None])
    values, attempt = out.copy(), 1
    while len(empty):
        r, j = empty[:, 0], empty[:, 1]
        probe = (mixed((j * 1009 + attempt).astype(np.uint64)) >> np.uint64(57)).astype(np.int64)
        hit = filled[r, probe]
        values[r[hit], j[hit]] = out[r[hit], probe[hit]]
        empty, attempt = empty[~hit], attempt + 1
    return values, filled


def packed(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """n x WIDTH bytes: the registers and a bit for each that was chosen."""
    values, filled = registers(first, h)
    return np.concatenate([values.astype("<u2").view(np.uint8).reshape(len(values), -1), np.packbits(filled, axis=1)], 1)


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = data.reshape(-1, WIDTH)
    return np.ascontiguousarray(rows[:, : 2 * REGISTERS]).view("<u2"), np.unpackbits(rows[:, 2 * REGISTERS :], axis=1).astype(bool)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """n x BANDS 64-bit keys; equal where a band's registers agree."""
    part = regs.reshape(len(regs), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), part.shape[:2])
    packed = part[..., 0] | (part[..., 1] << np.uint64(16)) | (part[..., 2] << np.uint64(32)) | (part[..., 3] << np.uint64(48))
    return mixed(packed ^ mixed(key + np.uint64(1))).view(np.int64)


def estimate(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of rows of (registers, chosen), corrected for chance agreement, and the registers it rests on.

    Of the union's shingles in a register the smallest decides, and it is as
    likely as any other of them: the registers that either set chose agree with
    the probability of the similarity, or by a collision of mantissas.
    """
    cells = (a[1] | b[1]).sum(1)
    agree = ((a[0] == b[0]) & a[1] & b[1]).sum(1) / np.maximum(cells, 1)
    return np.clip((agree - COLLISION) / (1 - COLLISION), 0, 1), cells


def surely_below(similarity: np.ndarray, cells: np.ndarray, threshold: float, risk: float = 1e-9) -> np.ndarray:
    """Estimates that two sets at the threshold have with a chance below ``risk`` (Chernoff's bound in the number of registers)."""
    x = np.clip(similarity, 1e-12, 1 - 1e-12)
    gap = x * np.log(x / threshold) + (1 - x) * np.log((1 - x) / (1 - threshold))
    return (similarity < threshold) & (cells * gap > -np.log(risk))
