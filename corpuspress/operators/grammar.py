"""Grammar compressors: Re-Pair, edit-sensitive parsing, longest-first substitution.

A grammar is a list of rules; symbols below 256 are bytes, 256 + i is rule i.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np

from ..functions.bits import BitReader, BitWriter, Words, bits_for, read_vbyte
from ..functions.coders import Arithmetic, canonical, code_lengths
from .lz import of
from .suffixes import lcp_intervals
from .transforms import escape, unescape

Rule = tuple[int, int]


def repair_grammar(data: bytes, max_rules: int = 0) -> tuple[list[int], list[Rule]]:
    """Replace the most frequent pair (non-overlapping occurrences; ties by pair) until none occurs twice.

    A pair is one number, its left symbol above its right one; ``where`` has the places that count.
    """
    s, n = list(data), len(data)
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    where: dict[int, set[int]] = {}
    get = where.get

    def shift(i: int) -> None:
        """The run of equal symbols from i lost its counted head: in the rest, the other occurrences count."""
        found, j = where[s[i] << 32 | s[i]], nxt[i]
        while j < n and s[j] == s[i]:
            if i in found:
                found.remove(i)
            else:
                found.add(i)
            i, j = j, nxt[j]

    if n > 1:
        a = np.frombuffer(data, np.uint8).astype(np.int64)
        pairs = a[:-1] << 32 | a[1:]
        # Equal symbols: an occurrence that overlaps the one before doesn't count.
        same = a[:-1] == a[1:]
        starts = np.maximum.accumulate(np.where(same & ~np.append(False, same[:-1]), np.arange(n - 1), 0))
        places = np.flatnonzero(~same | ((np.arange(n - 1) - starts) % 2 == 0))
        places = places[np.argsort(pairs[places], kind="stable")]
        found = pairs[places]
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        spots = places.tolist()
        where.update((pair, set(spots[b:e])) for pair, b, e in zip(found[first].tolist(), first.tolist(), [*first[1:].tolist(), len(spots)]))
    # Most places first, then the lowest pair, in one number.
    full = (1 << 64) - 1
    heap = [(n - len(p)) << 64 | pair for pair, p in where.items() if len(p) > 1]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    rules: list[Rule] = []
    while heap and not (max_rules and len(rules) >= max_rules):
        entry = pop(heap)
        pair, count = entry & full, n - (entry >> 64)
        found = get(pair, ())
        if len(found) != count:
            if len(found) > 1:
                push(heap, (n - len(found)) << 64 | pair)
            continue
        symbol, a, b = 256 + len(rules), pair >> 32, pair & 0xFFFFFFFF
        rules.append((a, b))
        touched = set()
        for i in sorted(found):
            j = nxt[i]
            if j >= n or s[i] != a or s[j] != b:
                continue
            p, k = prev[i], nxt[j]
            if p >= 0 and (old := get(s[p] << 32 | a)):
                old.discard(p)
            found.discard(i)
            if k < n and (old := get(b << 32 | s[k])) and j in old:
                old.remove(j)
                if s[k] == b:
                    shift(k)
            s[i], s[j], nxt[i] = symbol, -1, k
            if p >= 0:
                left = s[p]
                fresh = left << 32 | symbol
                touched.add(fresh)
                old = get(fresh)
                if old is None:
                    where[fresh] = {p}
                elif left != symbol or prev[p] not in old:
                    old.add(p)
            if k < n:
                prev[k] = i
                fresh = symbol << 32 | s[k]
                touched.add(fresh)
                old = get(fresh)
                if old is None:
                    where[fresh] = {i}
                elif s[k] != symbol or p not in old:
                    old.add(i)
        where.pop(pair, None)
        for pair in touched:
            if len(found := get(pair, ())) > 1:
                push(heap, (n - len(found)) << 64 | pair)
    out, i = [], 0
    while i < n:
        out.append(s[i])
        i = nxt[i]
    return out, rules


def expand(start: list[int], rules: list[tuple[int, ...]]) -> bytes:
    """Rules refer to earlier rules only, so they are expanded in order."""
    words: list[bytes] = [bytes([i]) for i in range(256)]
    for rule in rules:
        words.append(b"".join(words[s] for s in rule))
    return b"".join(words[s] for s in start)


def repair(data: bytes, coder, max_rules: int = 0) -> bytes:
    start, rules = repair_grammar(data, max_rules)
    symbols = [s for r in rules for s in r] + start
    e = coder.encoder(bytes(s for s in symbols if s < 256))
    e.num(len(rules), 0, (1 << 32) - 1)

    def put(s: int, known: int) -> None:
        e.bit(s >= 256)
        if s < 256:
            e.lit(s)
        else:
            e.num(s - 256, 0, known)

    for i, r in enumerate(rules):
        for s in r:
            put(s, i)
    for s in start:
        put(s, len(rules))
    return e.done()


def unrepair(data: bytes, coder, max_rules: int = 0) -> bytes:
    d = coder.decoder(data)

    def get(known: int) -> int:
        return 256 + d.num(0, known) if d.bit() else d.lit()

    rules = [(get(i), get(i)) for i in range(d.num(0, (1 << 32) - 1))]
    start = []
    while not d.eof():
        start.append(get(len(rules)))
    return expand(start, rules)


# Edit-sensitive parsing.


def label(left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One step of alphabet reduction: place of the lowest bit that differs from the left neighbour, and that bit; 0 for equal ones."""
    low = (left ^ own) & -(left ^ own)
    place = np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1  # exact: one bit is set
    return np.where(low > 0, 2 * place + ((own & low) > 0), 0)


def spans(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive parts that start at ``first``: size of each, and number of the part of each of ``n`` places."""
    size = np.diff(np.append(first, n))
    return size, np.repeat(np.arange(len(first)), size)


def block_starts(s: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether a block of one round starts at each place; blocks have 2 or 3 symbols, a sequence of one symbol is a block of 1.

    ``s`` holds sequences one after the other, ``head`` marks where each starts.
    Repeats are cut evenly.  Other stretches are cut before their landmarks:
    local maxima of the reduced alphabet, which depend on near symbols only.
    """
    n = len(s)
    after = np.append(~head[1:] & (s[1:] == s[:-1]), False)  # equal to the next
    before = np.append(False, after[:-1])
    loose = ~after & ~before
    # Segments: runs of equal symbols, and what lies between them.
    first = np.flatnonzero(head | (after & ~before) | (loose & ~np.append(False, loose[:-1])))
    size, _ = spans(first, n)
    lone = size == 1
    opens = head[first]
    same = ~loose[first]
    # A lone symbol joins the stretch before it, the first of a sequence the one after it.
    starts = opens | (~lone & ~np.append(False, (opens & lone)[:-1]))
    number = np.cumsum(starts) - 1
    first, same = first[starts], same[starts] & (np.bincount(number) == 1)
    size, part = spans(first, n)
    cut = np.zeros(n, bool)
    cut[first] = True
    marked = np.flatnonzero(~(same | (size < 4))[part])
    if len(marked):  # the stretches that are cut at landmarks
        names, own = s[marked], part[marked]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        final = names.copy()
        at = np.arange(len(names))
        length, of = spans(begin, len(names))
        most = np.maximum.reduceat(names, begin)
        while True:
            alive = most > 5
            if not alive.any():
                break
            keep = alive[of]
            names, at = names[keep], at[keep]
            length, most = length[alive], most[alive]
            begin = np.cumsum(length) - length
            of = np.repeat(np.arange(len(length)), length)
            fresh = np.append(0, label(names[:-1], names[1:]))
            fresh[begin] = names[begin] & 1
            less = np.maximum.reduceat(fresh, begin)
            names = np.where((less < most)[of], fresh, names)
            final[at] = names
            most = np.where(less < most, less, 0)  # those that don't shrink any more are done
        place, rest = marked - first[own], size[own]
        up = np.append(False, final[1:] > final[:-1])
        down = np.append(final[:-1] >= final[1:], False)
        cut[marked[up & down & (place >= 2) & (rest - place >= 2)]] = True
    first = np.flatnonzero(cut)
    size, part = spans(first, n)
    place, size = np.arange(n) - first[part], size[part]
    return (place % 2 == 0) & ((place < size - 1) | (size % 2 == 0) | (size == 1))


def esp_grammars(texts: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """For each text the root symbol (-1: empty text) and the binary rules (an array of two columns), in order of dependency.

    The rounds run over all texts at once.  A round's pairs are of its own: they end in a symbol that the round before made.
    """
    count = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    s = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    root = np.full(count, -1, np.int64)
    known = np.zeros(count, np.int64)
    owners, lefts, rights = [], [], []
    doc = np.repeat(np.arange(count), size)

    def numbered(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pair of its text each is, in any order, and the first place of each."""
        _, first, pair = np.unique(owner * (int(key.max()) + 1) + key, return_index=True, return_inverse=True)
        return first, pair

    while len(s):
        head = np.append(True, doc[1:] != doc[:-1])
        done = head & np.append(head[1:], True)
        if done.any():
            root[doc[done]] = s[done]
            s, doc, head = s[~done], doc[~done], head[~done]
            if not len(s):
                break
        first = np.flatnonzero(block_starts(s, head))
        three = np.diff(np.append(first, len(s))) == 3
        owner, a, b, c = doc[first], s[first], s[first + 1], s[first[three] + 2]
        wide = int(s.max()) + 1
        # Pairs of symbols, then those of a pair and the third symbol; both are numbered by their first place.
        at, pair = numbered(owner, a * wide + b)
        when, own, left, right = 2 * at, owner[at], a[at], b[at]
        if three.any():
            at3, pair3 = numbered(owner[three], pair[three] * wide + c)
            when = np.append(when, 2 * np.flatnonzero(three)[at3] + 1)
            own, left, right = np.append(own, owner[three][at3]), np.append(left, -1 - pair[three][at3]), np.append(right, c[at3])
        order = np.argsort(when)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        begin = np.searchsorted(own[order], np.arange(count))
        symbol = 256 + known[own] + rank - begin[own]
        left[left < 0] = symbol[-1 - left[left < 0]]
        owners.append(own[order]), lefts.append(left[order]), rights.append(right[order])
        known += np.bincount(own, minlength=count)
        s = symbol[pair]
        if three.any():
            s[three] = symbol[len(at) :][pair3]
        doc = owner
    if not owners:
        return [(int(r), np.zeros((0, 2), np.int64)) for r in root]
    order = np.argsort(np.concatenate(owners), kind="stable")
    rules = np.stack([np.concatenate(lefts)[order], np.concatenate(rights)[order]], 1)
    return list(zip(root.tolist(), np.split(rules, np.cumsum(known)[:-1])))


def esp_grammar(data: bytes) -> tuple[int, list[Rule]]:
    """Root symbol (-1: empty text) and binary rules, in order of dependency."""
    ((root, rules),) = esp_grammars([data])
    return root, list(map(tuple, rules.tolist()))


def by_left(root: int, rules: np.ndarray) -> tuple[int, np.ndarray]:
    """Renumber rules by their left sides as far as dependencies allow: a rule comes when its sides are there, lowest left side first."""
    rules = np.asarray(rules, np.int64).reshape(-1, 2)
    n, (a, b) = len(rules), rules.T
    first, second = a >= 256, (b >= 256) & (b != a)
    side = np.concatenate([a[first], b[second]]) - 256
    waiting = np.concatenate([np.flatnonzero(first), np.flatnonzero(second)])[np.argsort(side, kind="stable")].tolist()
    begin = np.append(0, np.cumsum(np.bincount(side, minlength=n))).tolist()
    missing = (first.astype(np.int64) + second).tolist()
    left, right, name, width = a.tolist(), b.tolist(), [*range(256), *[0] * n], (256 + n).bit_length()
    low = (1 << width) - 1
    # An entry is the names of both sides and the rule, in one number.
    heap = [(left[i] << width | right[i]) << width | i for i in np.flatnonzero(~first & ~second).tolist()]
    heapq.heapify(heap)
    pop, push, order = heapq.heappop, heapq.heappush, []
    while heap:
        i = pop(heap) & low
        name[256 + i] = 256 + len(order)
        order.append(i)
        for k in waiting[begin[i] : begin[i + 1]]:
            if missing[k] == 1:
                push(heap, (name[left[k]] << width | name[right[k]]) << width | k)
            else:
                missing[k] = 1
    named = np.array(name, np.int64)
    return name[root] if root >= 0 else root, named[rules[order]] if n else rules


# Codes for arrays of numbers.


def chunk(data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + data


def chunks(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


DELTA, GROUPS_OF_7, GROUPS_OF_3 = Words("delta"), Words("compressed"), Words("compressed", 3)


def fixed_words(v: np.ndarray, width: int) -> str:
    """The numbers at one width, one after the other."""
    out = np.empty((len(v), width), np.uint8)
    for k in range(width):
        out[:, k] = 48 + ((v >> (width - 1 - k)) & 1)
    return out.tobytes().decode()


def read_fixed(bits: str, n: int, width: int) -> np.ndarray:
    found = np.frombuffer(bits[: n * width].encode(), np.uint8).reshape(n, width)
    out = np.zeros(n, np.int64)
    for k in range(width):
        out = out << 1 | (found[:, k] & 1)
    return out


def put_plain(v: list[int]) -> bytes:
    w = BitWriter()
    v = np.asarray(v, np.int64)
    width = bits_for(int(v.max(initial=0)))
    w.compressed(len(v))
    w.compressed(width)
    w.text(fixed_words(v, width))
    return w.done()


def get_plain(data: bytes) -> list[int]:
    r = BitReader(data)
    n, width = r.compressed(), r.compressed()
    return read_fixed(r.bits[r.at :], n, width).tolist()


def put_huffman(v: list[int]) -> bytes:
    v = np.asarray(v, np.int64)
    lengths = code_lengths(dict(zip(*(x.tolist() for x in np.unique(v, return_counts=True)))))
    codes, w = canonical(lengths), BitWriter()
    w.compressed(len(v))
    w.compressed(len(lengths))
    w.text("".join(GROUPS_OF_7[x] for s in sorted(lengths) for x in (s, lengths[s])))
    w.text("".join(map(codes.__getitem__, v.tolist())))
    return w.done()


def get_huffman(data: bytes) -> list[int]:
    # The numbers of the header are whole bytes.
    n, at = read_vbyte(data, 0)
    count, at = read_vbyte(data, at)
    lengths = {}
    for _ in range(count):
        s, at = read_vbyte(data, at)
        lengths[s], at = read_vbyte(data, at)
    codes, out = {w: s for s, w in canonical(lengths).items()}, []
    bits, at, least, find = BitReader(data).bits, 8 * at, min(lengths.values(), default=0), codes.get
    for _ in range(n):
        end = at + least
        while (s := find(bits[at:end])) is None:
            end += 1
        out.append(s)
        at = end
    return out


def put_diff(v: list[int]) -> bytes:
    """Zigzag differences in delta code."""
    w, v = BitWriter(), np.asarray(v, np.int64)
    w.compressed(len(v))
    d = np.diff(v, prepend=0)
    w.text("".join(map(DELTA.__getitem__, np.where(d >= 0, 2 * d, -2 * d - 1).tolist())))
    return w.done()


def get_diff(data: bytes) -> list[int]:
    r, out = BitReader(data), []
    n = r.compressed()
    bits, at, one = r.bits, r.at, r.bits.index
    for _ in range(n):
        mark = one("1", at) + 1
        end = 2 * mark - 1 - at  # as many digits as there were zeros
        at = end + int(bits[mark:end], 2)
        out.append(int(bits[end:at], 2))
    d = np.array(out, np.int64)
    return np.cumsum(np.where(d % 2 == 0, d // 2, -(d + 1) // 2)).tolist()


def put_range_fit(v: list[int]) -> bytes:
    """Each number at the width of the range between the smallest one still to come and the largest so far and one to come."""
    w, v = BitWriter(), np.asarray(v, np.int64)
    w.compressed(len(v))
    low = np.minimum.accumulate(v[::-1])[::-1]
    width = bits_for(int((v - low).max(initial=0)))
    w.compressed(width)
    own = fixed_words(v - low, width)
    w.text("".join([GROUPS_OF_3[f] + own[i : i + width] for f, i in zip(np.diff(low, prepend=0).tolist(), range(0, len(own), width))]))
    return w.done()


def get_range_fit(data: bytes) -> list[int]:
    r, low, out = BitReader(data), 0, []
    n, width = r.compressed(), r.compressed()
    bits, at = r.bits, r.at
    for _ in range(n):
        shift, more = 0, True
        while more:
            group = int(bits[at : at + 4], 2)
            at += 4
            more = group > 7
            low += (group & 7) << shift
            shift += 3
        out.append(low + int(bits[at : at + width], 2))
        at += width
    return out


def put_arithmetic(v: list[int]) -> bytes:
    """Bytes of the numbers through the range coder."""
    v = np.asarray(v, np.int64)
    size = max(1, (bits_for(int(v.max(initial=0))) + 7) // 8)
    raw = v.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].tobytes()
    e = Arithmetic().encoder(raw)
    e.lits(raw)
    return bytes([size]) + e.done()


def get_arithmetic(data: bytes) -> list[int]:
    size, raw = data[0], Arithmetic().decoder(data[1:]).rest()
    wide = np.zeros((len(raw) // size, 8), np.uint8)
    wide[:, 8 - size :] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return wide.reshape(-1).view(">i8").tolist()


def put_wavelet(v: list[int]) -> bytes:
    """Bit planes of a wavelet matrix: each plane stably sorts the numbers by its bit."""
    a = np.asarray(v, np.int64)
    w, width = BitWriter(), bits_for(int(a.max(initial=0)))
    w.compressed(len(a))
    w.compressed(width)
    for k in range(width - 1, -1, -1):
        bit = (a >> k) & 1
        w.text((48 + bit).astype(np.uint8).tobytes().decode())
        a = np.concatenate([a[bit == 0], a[bit == 1]])
    return w.done()


def get_wavelet(data: bytes) -> list[int]:
    r = BitReader(data)
    n, width = r.compressed(), r.compressed()
    at, out = np.arange(n), np.zeros(n, np.int64)
    for k in range(width - 1, -1, -1):
        bit = np.frombuffer(r.bits[r.at : r.at + n].encode(), np.uint8).astype(np.int64) - 48
        r.at += n
        ones = np.cumsum(bit)
        zeros = n - int(ones[-1]) if n else 0
        own = bit[at]
        out |= own << k
        at = np.where(own == 1, zeros + ones[at] - 1, at - ones[at])
    return out.tolist()


def increasing(v: list[int], strict: bool = False) -> list[int]:
    """Indices of a longest non-decreasing (or increasing) subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    find, put, count = bisect_left if strict else bisect_right, piles.append, 0
    for x in v:
        k = find(tops, x)
        put(k)
        if k == count:
            tops.append(x)
            count += 1
        else:
            tops[k] = x
    # Back from the last one of the last pile: each time the nearest one before it in the pile before.
    piles.reverse()
    out, at = [], -1
    for k in range(count - 1, -1, -1):
        at = piles.index(k, at + 1)
        out.append(len(v) - 1 - at)
    return out[::-1]


def monotone_layers(v: list[int], strategy: str = "optimal") -> list[tuple[bool, list[int]]]:
    """Cut a sequence into monotone subsequences: (rising, indices).

    ``optimal`` takes a longest one of what is left each time, ``greedy`` deals
    each number to the first pile on which it doesn't fall.
    """
    out: list[tuple[bool, list[int]]] = []
    if strategy == "greedy":
        piles: list[list[int]] = []
        tops: list[int] = []  # negated: they rise from pile to pile
        for i, x in enumerate(v):
            k = bisect_left(tops, -x)
            if k == len(piles):
                piles.append([i])
                tops.append(-x)
            else:
                piles[k].append(i)
                tops[k] = -x
        return [(True, p) for p in piles]
    own = np.asarray(v, np.int64)
    left = np.arange(len(own))
    while len(left):
        up, down = increasing(own.tolist()), increasing((-own).tolist())
        rising = len(up) >= len(down)
        pick = up if rising else down
        out.append((rising, left[pick].tolist()))
        left, own = np.delete(left, pick), np.delete(own, pick)
        if len(out) >= 32 and len(left):  # what is left is dealt to piles: many short layers cost more than they save
            out += [(r, left[p].tolist()) for r, p in monotone_layers(own.tolist(), "greedy")]
            break
    return out


def put_succinct(v: list[int], strategy: str = "optimal") -> bytes:
    """The layer of each number, and each layer's numbers as differences."""
    v = np.asarray(v, np.int64).tolist()
    layers = monotone_layers(v, strategy)
    owner = [0] * len(v)
    for k, (_, places) in enumerate(layers):
        for i in places:
            owner[i] = k
    parts = [put_plain(owner), put_plain([int(r) for r, _ in layers])]
    return b"".join(chunk(p) for p in [*parts, *(put_diff([v[i] for i in places]) for _, places in layers)])


def get_succinct(data: bytes) -> list[int]:
    owner, _, *layers = chunks(data)
    values = [iter(get_diff(x)) for x in layers]
    return [next(values[k]) for k in get_plain(owner)]


ARRAYS = {
    "plain": (put_plain, get_plain), "huffman": (put_huffman, get_huffman), "arithmetic": (put_arithmetic, get_arithmetic), "wavelet_tree": (put_wavelet, get_wavelet),
    "succinct": (put_succinct, get_succinct), "diff": (put_diff, get_diff), "range_fit": (put_range_fit, get_range_fit),
}
#: With those that options of the above make.
CODES = {**ARRAYS, "succinct_greedy": (lambda v: put_succinct(v, "greedy"), get_succinct)}


def esp(data: bytes, slp_coder: str = "sorted", d_coding: str = "plain") -> bytes:
    return esp_all([data], slp_coder, d_coding)[0]


def esp_all(texts: list[bytes], slp_coder: str = "sorted", d_coding: str = "plain") -> list[bytes]:
    return [put_esp(root, rules, slp_coder, d_coding) for root, rules in esp_grammars(texts)]


def put_esp(root: int, rules: np.ndarray, slp_coder: str, d_coding: str) -> bytes:
    if slp_coder == "sorted":
        root, rules = by_left(root, rules)
    w = BitWriter()
    width = bits_for(256 + len(rules))
    w.write(width, 6)
    w.write(root + 1, width)
    if slp_coder == "plain":
        w.text(fixed_words(rules.ravel(), width))
        return w.done()
    # Left sides rise but for dependencies: zigzag steps; right sides by the chosen code.
    return b"".join(chunk(p) for p in (w.done(), put_diff(rules[:, 0]), CODES[d_coding][0](rules[:, 1])))


def unesp(data: bytes, slp_coder: str = "sorted", d_coding: str = "plain") -> bytes:
    head = data if slp_coder == "plain" else chunks(data)[0]
    r = BitReader(head)
    width = r.read(6)
    root = r.read(width) - 1
    if root < 0:
        return b""
    if slp_coder == "plain":
        sides = read_fixed(r.bits[r.at :], (len(r.bits) - r.at) // width, width).tolist()
        left, right = sides[::2], sides[1::2]
    else:
        _, left, right = chunks(data)
        left, right = get_diff(left), CODES[d_coding][1](right)
    words = [bytes([i]) for i in range(256)]
    for a, b in zip(left, right):
        words.append(words[a] + words[b])
    return words[root]


# Longest-first substitution.


def ends(v: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each range (inclusive) of ``v``, by ranges of sizes that double."""
    low, high = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    least = most = v
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        a, b = left[own], right[own] + 1 - (1 << k)
        low[own], high[own] = np.minimum(least[a], least[b]), np.maximum(most[a], most[b])
        least, most = np.minimum(least[: -(1 << k)], least[1 << k :]), np.maximum(most[: -(1 << k)], most[1 << k :])
    return low, high


def longest_first(data: bytes, least: int = 2) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Rules (start, length) and occurrences (position, rule): the longest repeat without overlaps first.

    Candidates are the common-prefix intervals.  One whose occurrences are partly taken, or overlap, comes back with
    the longest prefix of which two occurrences are still free and apart, unless that is its parent's.
    """
    x = of(data)
    left, right, deep = lcp_intervals(x.lcp, least)
    around = np.append(x.lcp, 0)
    floor = np.maximum(np.maximum(around[left], around[right + 1]), least - 1)
    low, high = ends(x.sa, left, right)
    top = np.minimum(deep, high - low)  # two occurrences of a longer prefix overlap
    kept = np.flatnonzero(top > floor)
    kept = kept[np.lexsort((right[kept], left[kept]))]
    first = np.where(right - left < 64, low, x.sa[left])
    top, first, left, right, floor = (v[kept].tolist() for v in (top, first, left, right + 1, floor))
    n = len(data)
    width = (n + 1).bit_length()
    mask = (1 << width) - 1
    # An entry is the length (the longest first), the first place and the interval, in one number.
    heap = [((n - d) << width | f) << width | k for k, (d, f) in enumerate(zip(top, first))]
    heapq.heapify(heap)
    sa, pop, push = x.sa.tolist(), heapq.heappop, heapq.heappush
    taken = bytearray(n)
    marks, find = np.frombuffer(taken, np.uint8), taken.find
    rules, found = [], []
    free_places, used = np.arange(n), 0
    while heap:
        entry = pop(heap)
        k, d = entry & mask, n - (entry >> 2 * width)
        a, b = left[k], right[k]
        if b - a == 2:
            p, q = sa[a], sa[a + 1]
            if taken[p] or taken[q]:
                continue
            if p > q:
                p, q = q, p
            if not taken[p + d - 1] and not taken[q + d - 1]:
                free, shorter = (p, q), 0
            else:
                free = ()
                near, far = find(1, p, p + d), find(1, q, q + d)
                shorter = min(d - 1, q - p, near - p if near >= 0 else d, far - q if far >= 0 else d)
        else:
            if b - a <= 64:
                spots = [p for p in sa[a:b] if not taken[p]]
                spots.sort()
            else:
                if 2 * (n - used) < len(free_places):
                    free_places = free_places[marks[free_places] == 0]
                if b - a < len(free_places):
                    spots = np.sort(x.sa[a:b])
                else:
                    rank = x.isa[free_places]
                    spots = free_places[(rank >= a) & (rank < b)]
                spots = spots[marks[spots] == 0].tolist()
            if len(spots) < 2:
                continue
            free, last = [], -1
            for p in spots:
                if p >= last and not taken[p + d - 1]:
                    free.append(p)
                    last = p + d
            if len(free) < 2:
                rooms = sorted([((e - p if (e := find(1, p, p + d)) >= 0 else d), p) for p in spots], reverse=True)
                shorter, near, far = 0, n, -1
                for room, p in rooms:
                    near, far = min(near, p), max(far, p)
                    shorter = max(shorter, min(room, far - near))
                shorter = min(shorter, d - 1)
        if len(free) > 1:
            for p in free:
                taken[p : p + d] = b"\1" * d
                found.append((p, len(rules)))
            rules.append((free[0], d))
            used += d * len(free)
        elif shorter > floor[k]:
            push(heap, ((n - shorter) << width | first[k]) << width | k)
    return rules, sorted(found)


def substituted(data: bytes, rules: list[tuple[int, int]], found: list[tuple[int, int]]) -> list[int]:
    out, at = [], 0
    for p, k in found:
        out += data[at:p]
        out.append(256 + k)
        at = p + rules[k][1]
    return out + list(data[at:])


def put_symbols(e, symbols: list[int], known: int) -> None:
    for s in symbols:
        e.bit(s >= 256)
        if s >= 256:
            e.num(s - 256, 0, known)
        else:
            e.lit(s)


def get_symbols(d, n: int, known: int) -> list[int]:
    return [256 + d.num(0, known) if d.bit() else d.lit() for _ in range(n)]


def lfs_grammar(data: bytes, least: int = 2, layers: int = 1) -> tuple[list[int], list[list[int]]]:
    """Start sequence and rules; with two layers rules may hold rules made from the rules' own repeats."""
    text = escape(data)
    rules, found = longest_first(text, least)
    start = substituted(text[:-1], rules, found) if not found or found[-1][0] + rules[found[-1][1]][1] < len(text) else substituted(text, rules, found)
    words = [text[p : p + n] for p, n in rules]
    if layers == 1 or not words:
        return start, [list(w) for w in words]
    # Zeros separate the words: no text has one before its end, and no repeat may hold one.
    joined = b"\0".join(words) + b"\0"
    inner, places = longest_first(joined, max(2, least))
    keep = [i for i, (p, n) in enumerate(inner) if 0 not in joined[p : p + n] and n > 1]
    number = {k: i for i, k in enumerate(keep)}
    places = [(p, number[k]) for p, k in places if k in number]
    inner = [inner[k] for k in keep]
    parts, own = [], []
    for s in substituted(joined, inner, places):
        if s == 0:
            parts.append(own)
            own = []
        else:
            own.append(s)
    shift = len(inner)
    return [s + shift if s >= 256 else s for s in start], [list(joined[p : p + n]) for p, n in inner] + parts


def lfs(data: bytes, coder, min_lrf: int = 2, layers: int = 1) -> bytes:
    start, rules = lfs_grammar(data, min_lrf, layers)
    e = coder.encoder(bytes(s for r in [*rules, start] for s in r if s < 256))
    e.num(len(rules), 0, (1 << 32) - 1)
    e.num(len(start), 0, (1 << 32) - 1)
    longest = max(map(len, rules), default=0)
    e.num(longest, 0, (1 << 32) - 1)
    for i, r in enumerate(rules):
        e.num(len(r), 0, longest)
        put_symbols(e, r, i)
    put_symbols(e, start, len(rules))
    return e.done()


def unlfs(data: bytes, coder, min_lrf: int = 2, layers: int = 1) -> bytes:
    d = coder.decoder(data)
    n, size, longest = (d.num(0, (1 << 32) - 1) for _ in range(3))
    rules = [tuple(get_symbols(d, d.num(0, longest), i)) for i in range(n)]
    text = expand(get_symbols(d, size, n), rules)
    return unescape(text if text.endswith(b"\0") else text + b"\0")


def depths(rules: list[tuple[int, ...]]) -> list[int]:
    """Height of each rule's derivation tree."""
    out: list[int] = []
    for r in rules:
        out.append(1 + max((out[s - 256] for s in r if s >= 256), default=0))
    return out
