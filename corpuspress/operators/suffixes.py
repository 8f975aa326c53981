"""Enhanced suffix arrays over batches of sequences, in numpy.

``sort_suffixes`` is prefix doubling that re-sorts only the suffixes that are
still tied.  ``neighbour_lcp`` reads common-prefix lengths off the ranks of the
doubling rounds.  ``lcp_intervals`` is the stack scan that turns the LCP array
into the tree of common-prefix intervals, and ``maximal_repeats`` keeps the
intervals whose occurrences differ in what precedes them.
"""

from __future__ import annotations

import numpy as np


def sort_suffixes(symbols: np.ndarray, doc: np.ndarray, depth: int | None = None, span: int = 1) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Sort all suffixes of a concatenation of sequences; none crosses into the next.

    ``symbols``: non-negative ints; suffixes are ordered within a sequence's
    own symbols only if the caller makes symbols differ between sequences.
    ``doc``: non-decreasing number of each position's sequence.  ``depth``:
    stop once that many symbols are compared.  ``span``: elements that one symbol
    already stands for (each position's symbol packs the next ``span`` elements).
    Returns the suffix array and the ranks after 1, 2, 4, ... times ``span`` elements (equal rank: that many symbols agree, an
    end of sequence counting as a symbol).
    """
    n = len(symbols)
    sa = np.argsort(symbols)
    s = symbols[sa]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    place = np.arange(n)
    head = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    levels = [(span, rank.astype(np.int32))]
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    h = span
    while len(slots) and (depth is None or h < depth):
        at = sa[slots]
        ahead = at + h
        inside = ahead < n
        ahead[~inside] = 0
        inside &= doc[ahead] == doc[at]
        key = rank[at] * (n + 1) + np.where(inside, rank[ahead] + 1, 0)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied]
        h *= 2
        levels.append((h, rank.astype(np.int32)))
    return sa, levels


def packed(data: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbols for ``sort_suffixes``: a text's number and its next bytes, as many as fit; the text's end is below all bytes."""
    n = len(data)
    span = min(6, (63 - int(doc[-1]).bit_length()) // 9)
    wide = np.concatenate([data.astype(np.int64) + 1, np.zeros(span, np.int64)])
    place = end - np.arange(n)
    symbols = doc.astype(np.int64)
    for k in range(span):
        symbols = symbols << 9 | np.where(place > k, wide[k : k + n], 0)
    return symbols, span


def neighbour_lcp(sa: np.ndarray, levels: list[tuple[int, np.ndarray]], end: np.ndarray, elements: np.ndarray | None = None) -> np.ndarray:
    """``lcp[i]``: common symbols of the suffixes at ``sa[i - 1]`` and ``sa[i]``; ``lcp[0]`` is 0.

    ``end[p]``: where position p's sequence ends.  Exact below the depth that
    the suffixes were sorted to, at least that depth otherwise.  Symbols that pack
    several elements leave a remainder, which is read off the ``elements``.
    """
    lcp = np.zeros(len(sa), np.int64)
    if len(sa) < 2:
        return lcp
    first = levels[0][1]
    live = np.flatnonzero(first[sa[1:]] == first[sa[:-1]]) + 1
    a, b = sa[live - 1], sa[live]
    room = np.minimum(end[a] - a, end[b] - b)
    got = np.zeros(len(live), np.int64)
    for h, rank in reversed(levels):
        can = got + h <= room
        x, y = np.where(can, a + got, 0), np.where(can, b + got, 0)
        got += np.where(can & (rank[x] == rank[y]), h, 0)
    left = np.arange(len(live))
    for _ in range(levels[0][0] - 1 if elements is not None else 0):
        left = left[got[left] < room[left]]
        left = left[elements[a[left] + got[left]] == elements[b[left] + got[left]]]
        got[left] += 1
    lcp[live] = got
    return lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All common-prefix intervals of depth ``least`` or more: left, right (inclusive), depth.

    A stack scan over the stretches of the LCP array that reach ``least``; an
    interval is emitted when the LCP falls below its depth.
    """
    hot = np.flatnonzero(lcp >= least)
    left, right, deep = [], [], []
    stack: list[tuple[int, int]] = []
    last = -2
    for i, v in zip(hot.tolist(), lcp[hot].tolist()):
        if i != last + 1:
            while stack:
                d, lb = stack.pop()
                left.append(lb), right.append(last), deep.append(d)
        lb = i - 1
        while stack and stack[-1][0] > v:
            d, lb = stack.pop()
            left.append(lb), right.append(i - 1), deep.append(d)
        if not stack or stack[-1][0] < v:
            stack.append((v, lb))
        last = i
    while stack:
        d, lb = stack.pop()
        left.append(lb), right.append(last), deep.append(d)
    return np.array(left, np.int64), np.array(right, np.int64), np.array(deep, np.int64)


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of ``lcp_intervals`` that can't be extended to the left either.

    ``before[p]``: the symbol before position p, a value of its own at a start
    of a sequence.  An interval is left-diverse if two of its suffixes, which
    are neighbours somewhere in it, have different symbols before them.
    """
    left, right, deep = lcp_intervals(lcp, least)
    differs = np.zeros(len(sa) + 1, np.int64)
    differs[2:] = np.cumsum(before[sa[1:]] != before[sa[:-1]]) if len(sa) > 1 else 0
    diverse = differs[right + 1] - differs[left + 1] > 0
    return left[diverse], right[diverse], deep[diverse]


def covered(sa: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Marks each position that a repeat of ``least`` or more symbols covers.

    The deepest interval around a suffix has the larger LCP of its two
    neighbours as its depth; shallower ones cover a part of the same span, so
    the union over all intervals needs that one only.
    """
    n = len(sa)
    deep = lcp.copy()
    if n:
        deep[:-1] = np.maximum(deep[:-1], lcp[1:])
    long = deep >= least
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, sa[long], 1)
    np.add.at(delta, sa[long] + deep[long], -1)
    return np.cumsum(delta[:-1]) > 0
