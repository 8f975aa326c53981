"""Byte transforms: run lengths, move-to-front, Burrows-Wheeler, escaping."""

from __future__ import annotations

import numpy as np

from ..functions.bits import read_vbyte, vbyte
from .suffixes import packed, sort_suffixes


def run_starts(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)


def rle(data: bytes, offset: int = 0) -> bytes:
    """A run of r >= 2 becomes the byte twice and vbyte(r - 2 + offset)."""
    a = np.frombuffer(data, np.uint8)
    starts = run_starts(a)
    size = np.diff(np.append(starts, len(a)))
    single = np.append(0, np.cumsum(size > 1))
    if not single[-1]:
        return data
    out, at = [], 0
    for i in np.flatnonzero(size > 1).tolist():
        s, r = int(starts[i]), int(size[i])
        out += [data[at : s + 2], vbyte(r - 2 + offset)]
        at = s + r
    return b"".join([*out, data[at:]])


def unrle(data: bytes, offset: int = 0) -> bytes:
    out, at, last = bytearray(), 0, -1
    while at < len(data):
        c = data[at]
        at += 1
        out.append(c)
        if c == last:
            n, at = read_vbyte(data, at)
            out += bytes([c]) * (n - offset)
            last = -1
        else:
            last = c
    return bytes(out)


def mtf(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray(len(data))
    for i, c in enumerate(data):
        r = table.index(c)
        if r:
            table.insert(0, table.pop(r))
        out[i] = r
    return bytes(out)


def unmtf(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray(len(data))
    for i, r in enumerate(data):
        c = table[r]
        if r:
            table.insert(0, table.pop(r))
        out[i] = c
    return bytes(out)


#: Bytes that may serve as the escape byte, best first.
POOL = (255, 254, 192, 193, 245, 246, 247, 248, 249, 250, 251, 252, 253)


def escape_map(escaped: tuple[int, ...]) -> tuple[int, dict[int, int]]:
    """The escape byte and what stands for each escaped byte after it; the escape byte stands for itself."""
    free = [b for b in POOL if b not in escaped]
    lead, rest = free[0], [b for b in (*free[1:], *range(1, 256)) if b not in escaped and b != free[0]]
    return lead, {**dict(zip(escaped, rest)), lead: lead}


def escape(data: bytes, escaped: tuple[int, ...] = (0,), terminate: bool = True) -> bytes:
    lead, table = escape_map(escaped)
    out = data.replace(bytes([lead]), bytes([lead, lead]))
    for b in escaped:
        out = out.replace(bytes([b]), bytes([lead, table[b]]))
    return out + b"\0" if terminate else out


def unescape(data: bytes, escaped: tuple[int, ...] = (0,), terminate: bool = True) -> bytes:
    if terminate:
        if not data.endswith(b"\0"):
            raise ValueError("the closing zero is missing")
        data = data[:-1]
    lead, table = escape_map(escaped)
    back = {v: k for k, v in table.items()}
    parts = data.split(bytes([lead]))
    out, i = [parts[0]], 1
    while i < len(parts):
        p = parts[i]
        if p:
            out += [bytes([back[p[0]]]), p[1:]]
            i += 1
        else:  # two escape bytes in a row
            out += [bytes([lead]), parts[i + 1] if i + 1 < len(parts) else b""]
            i += 2
    return b"".join(out)


def suffix_array(data: bytes) -> np.ndarray:
    a, doc = np.frombuffer(data, np.uint8), np.zeros(len(data), np.int64)
    if not len(a):
        return doc
    symbols, span = packed(a, doc, doc + len(a))
    return sort_suffixes(symbols, doc, span=span)[0]


def bwt(data: bytes) -> bytes:
    """Last column of the sorted suffixes of the text with its closing zero."""
    text = escape(data)
    a = np.frombuffer(text, np.uint8)
    return a[suffix_array(text) - 1].tobytes()


def lf_map(last: np.ndarray) -> np.ndarray:
    """LF: the rank of each entry of the last column among the sorted entries."""
    order = np.argsort(last, kind="stable")
    lf = np.empty(len(last), np.int64)
    lf[order] = np.arange(len(last))
    return lf


def unbwt(data: bytes) -> bytes:
    """Walk LF backwards from the row of the closing zero, all powers of two at once."""
    last = np.frombuffer(data, np.uint8)
    n = len(last)
    if not n:
        return b""
    lf = lf_map(last)
    walk = np.zeros(n, np.int64)  # row 0 is the suffix that is the closing zero alone
    walk[0], jump, done = 0, lf, 1
    while done < n:
        step = min(done, n - done)
        walk[done : done + step] = jump[walk[:step]]
        done += step
        jump = jump[jump]
    text = last[walk[: n - 1]][::-1].tobytes() if n > 1 else b""
    return unescape(text + b"\0")
