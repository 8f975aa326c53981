"""Hash functions as column expressions (64-bit, wrapping), and rolling hashes of k-mers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _product(v: Column, factor: int) -> Column:
    """Product modulo 2 ** 64; the JVM's longs wrap only outside ANSI mode, so it is put together from 32-bit halves."""
    low, high = factor & 0xFFFFFFFF, factor >> 32
    a, b = v.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(v, 32)
    cross = _half(a, high).bitwiseXOR(F.lit(0))
    upper = _add32(_add32(cross, _half(b, low)), _carry(a, low))
    return F.shiftleft(upper, 32).bitwiseOR(_low(a, low))


def _parts(x: Column, c: int) -> tuple[Column, Column]:
    """x * c for 32-bit x and c as (bits 0-15 of the low part summed up, rest), without overflow."""
    return x * (c & 0xFFFF), x * (c >> 16)


def _low(x: Column, c: int) -> Column:
    p, q = _parts(x, c)
    return (p + F.shiftleft(q.bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def _carry(x: Column, c: int) -> Column:
    p, q = _parts(x, c)
    return (F.shiftrightunsigned(p + F.shiftleft(q.bitwiseAND(0xFFFF), 16), 32) + F.shiftrightunsigned(q, 16)).bitwiseAND(0xFFFFFFFF)


def _half(x: Column, c: int) -> Column:
    return _low(x, c)


def _add32(x: Column, y: Column) -> Column:
    return (x + y).bitwiseAND(0xFFFFFFFF)


def knuth(v: Column) -> Column:
    """Multiplicative hash by the golden ratio."""
    return _product(v, 0x9E3779B97F4A7C15)


def vigna(v: Column) -> Column:
    """The finaliser of splitmix64."""
    x = _product(v.bitwiseXOR(F.shiftrightunsigned(v, 30)), 0xBF58476D1CE4E5B9)
    x = _product(x.bitwiseXOR(F.shiftrightunsigned(x, 27)), 0x94D049BB133111EB)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))


def mixer(v: Column) -> Column:
    """The finaliser of MurmurHash3."""
    x = _product(v.bitwiseXOR(F.shiftrightunsigned(v, 33)), 0xFF51AFD7ED558CCD)
    x = _product(x.bitwiseXOR(F.shiftrightunsigned(x, 33)), 0xC4CEB9FE1A85EC53)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))


def rabin_karp(data: bytes, k: int, base: int = 257, modulus: int = (1 << 31) - 1) -> np.ndarray:
    """Rolling hashes of all strings of k bytes."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(a) - k + 1), np.int64)
    for j in range(k):
        out = (out * base + a[j : len(a) - k + 1 + j]) % modulus
    return out
