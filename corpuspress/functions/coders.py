"""Coders: from tokens (bits, literals, numbers in ranges) to bytes and back.

An encoder is made with the literals that it will see, in order, so that it can
build its model; ``bit``, ``lit``, ``num`` and ``mind`` take a token with its
range, ``done`` returns the bytes.  Ties in every model are broken by byte value,
so streams are the same on all machines.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections import Counter
from functools import cache

import numpy as np

from .bits import BitReader, BitWriter, Words, bits_for, read_vbyte


#: The groups of coders: for any numbers, by the literals' counts, and those that may hold tokens back.
GROUPS = {"universal": ("ascii", "bit", "gamma", "delta", "ternary"), "entropy": ("huff",), "consuming": ("arithmetic", "sle")}
#: The eight bits of each byte.
OCTETS = [format(c, "08b") for c in range(256)]
#: Numbers in groups of seven bits.
SEVENS = Words("compressed")


class Fixed:
    """Numbers at the width of their range; the base of all coders."""

    name = "bit"

    def encoder(self, literals: bytes):
        return FixedEncoder(literals)

    def decoder(self, data: bytes):
        return FixedDecoder(data)


class FixedEncoder:
    def __init__(self, literals: bytes):
        self.out = BitWriter()

    def bit(self, b: int) -> None:
        self.out.text("1" if b else "0")

    def lit(self, c: int) -> None:
        self.out.write(c, 8)

    def lits(self, data: bytes) -> None:
        self.out.text("".join(map(OCTETS.__getitem__, data)))

    def num(self, v: int, low: int, high: int) -> None:
        self.out.write(v - low, (high - low).bit_length() or 1)

    def nums(self, values: list[int], highs: list[int]) -> None:
        """Numbers from 0 to each one's own end."""
        for v, high in zip(values, highs):
            self.num(v, 0, high)

    def mind(self, v: int, low: int, high: int) -> None:
        self.num(v, low, high)

    def done(self) -> bytes:
        return self.out.done()


class FixedDecoder:
    def __init__(self, data: bytes):
        self.src = BitReader(data)

    def eof(self) -> bool:
        return self.src.eof()

    def bit(self) -> int:
        return self.src.read(1)

    def lit(self) -> int:
        return self.src.read(8)

    def lits(self, n: int) -> bytes:
        return self.src.bytes(n)

    def rest(self) -> bytes:
        """All literals to the end of the stream."""
        out = bytearray()
        while not self.eof():
            out.append(self.lit())
        return bytes(out)

    def num(self, low: int, high: int) -> int:
        return self.src.read((high - low).bit_length() or 1) + low

    def mind(self, low: int, high: int) -> int:
        return self.num(low, high)


class Ascii(Fixed):
    """Decimal digits and a colon; literals as they are; bits as 0 and 1."""

    name = "ascii"

    def encoder(self, literals):
        return AsciiEncoder(literals)

    def decoder(self, data):
        return AsciiDecoder(data)


class AsciiEncoder(FixedEncoder):
    def bit(self, b):
        self.out.write(48 + bool(b), 8)

    def num(self, v, low, high):
        for c in b"%d:" % v:
            self.out.write(c, 8)


class AsciiDecoder(FixedDecoder):
    def bit(self):
        return self.src.read(8) - 48

    def num(self, low, high):
        v = 0
        while (c := self.src.read(8)) != 58:
            v = 10 * v + c - 48
        return v


class Universal(Fixed):
    """gamma, delta or ternary codes of the distance to the range's lower end."""

    def __init__(self, name: str):
        self.name = name

    def encoder(self, literals):
        e = UniversalEncoder(literals)
        e.code = getattr(e.out, self.name)
        return e

    def decoder(self, data):
        d = UniversalDecoder(data)
        d.code = getattr(d.src, self.name)
        return d


class UniversalEncoder(FixedEncoder):
    def lit(self, c):
        self.code(c)

    def lits(self, data):
        words = {}
        for c in set(data):
            one = BitWriter()
            getattr(one, self.code.__name__)(c)
            words[c] = one.bits()
        self.out.text("".join(map(words.__getitem__, data)))

    def num(self, v, low, high):
        self.code(v - low)


@cache
def byte_words(name: str) -> tuple[re.Pattern, dict[str, int], int]:
    """Of a universal code: a pattern that finds the next word of a byte, the byte of each word, and the longest word's length."""
    words = {}
    for c in range(256):
        w = BitWriter()
        getattr(w, name)(c)
        words[w.bits()] = c
    if name == "ternary":
        pattern = "(?:00|01|10)*11"
    else:  # zeros, what says how many digits follow, digits; lengths of letters first
        parts = []
        for width in (7, 6, 8, *range(5, 0, -1)):
            head = "0" * width + "1" if name == "gamma" else "0" * bits_for(width) + "1" + format(width, "b")
            parts.append(f"{head}[01]{{{width}}}")
        pattern = "|".join(parts)
    return re.compile(pattern), words, max(map(len, words))


class UniversalDecoder(FixedDecoder):
    def lit(self):
        return self.code()

    def lits(self, n):
        pattern, words, longest = byte_words(self.code.__name__)
        found = pattern.findall(self.src.bits, self.src.at, self.src.at + n * longest)[:n]
        self.src.at += sum(map(len, found))
        return bytes(map(words.__getitem__, found))

    def rest(self):
        pattern, words, _ = byte_words(self.code.__name__)
        found = pattern.findall(self.src.bits, self.src.at)
        self.src.at = len(self.src.bits)
        return bytes(map(words.__getitem__, found))

    def num(self, low, high):
        return self.code() + low


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths; ties by the smallest symbol of a subtree."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    symbols = sorted(counts)
    heap = [(counts[s], s, i) for i, s in enumerate(symbols)]
    heapq.heapify(heap)
    above, k = [0] * (2 * len(symbols) - 1), len(symbols)
    while len(heap) > 1:
        a = heapq.heappop(heap)
        b = heap[0]
        above[a[2]] = above[b[2]] = k
        heapq.heapreplace(heap, (a[0] + b[0], min(a[1], b[1]), k))
        k += 1
    deep = [0] * k
    for i in range(k - 2, -1, -1):
        deep[i] = deep[above[i]] + 1
    length = dict(zip(symbols, deep))
    return {s: length[s] for s in counts}


def canonical(lengths: dict[int, int]) -> dict[int, str]:
    """Canonical codewords: by length, then symbol."""
    out, code, last = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s], last = format(code, f"0{n}b"), n
        code += 1
    return out


class Huffman(Fixed):
    """Canonical Huffman codes for literals.

    Header: a flag (0: at most one distinct literal, bytes stay raw), then the
    longest length, the number of codes of each length, the alphabet's size and
    the symbols in code order.
    """

    name = "huff"

    def encoder(self, literals):
        return HuffmanEncoder(literals)

    def decoder(self, data):
        return HuffmanDecoder(data)


class HuffmanEncoder(FixedEncoder):
    def __init__(self, literals):
        super().__init__(literals)
        counts = Counter(literals)
        self.table = None
        if len(counts) < 2:
            self.bit(0)
            return
        self.bit(1)
        lengths = code_lengths(counts)
        self.table = canonical(lengths)
        longest = max(lengths.values())
        self.out.compressed(longest)
        for n in range(1, longest + 1):
            self.out.compressed(sum(x == n for x in lengths.values()))
        self.out.compressed(len(lengths))
        for s in sorted(lengths, key=lambda s: (lengths[s], s)):
            self.out.write(s, 8)

    def lit(self, c):
        self.out.text(self.table[c] if self.table else format(c, "08b"))

    def lits(self, data):
        if self.table:
            self.out.text("".join(map(self.table.__getitem__, data)))
        else:
            super().lits(data)


class HuffmanDecoder(FixedDecoder):
    def __init__(self, data):
        super().__init__(data)
        self.codes = None
        if not self.src.eof() and self.bit():
            longest = self.src.compressed()
            sizes = [self.src.compressed() for _ in range(longest)]
            symbols = [self.src.read(8) for _ in range(self.src.compressed())]
            lengths, at = {}, 0
            for n, k in enumerate(sizes, 1):
                lengths.update(dict.fromkeys(symbols[at : at + k], n))
                at += k
            self.codes = {w: s for s, w in canonical(lengths).items()}
            self.shortest, self.longest = min(lengths.values()), longest

    def lit(self):
        if self.codes is None:
            return self.src.read(8)
        bits, at = self.src.bits, self.src.at
        end = at + self.shortest
        while (s := self.codes.get(bits[at:end])) is None:
            end += 1
        self.src.at = end
        return s

    def lits(self, n):
        return self.many(n) if self.codes is not None else self.src.bytes(n)

    def rest(self):
        left = len(self.src.bits) - self.src.at
        return self.many(left) if self.codes is not None else self.src.bytes(left // 8)

    def many(self, n: int) -> bytes:
        """The next n symbols, or all to the end of the stream, by tables of what each next few bits begin with."""
        if n < 400 or self.longest > 16:
            return bytes(self.lit() for _ in range(n) if not self.src.eof())
        at, width = self.src.at, self.longest
        bits = np.frombuffer(self.src.bits[at : at + n * width].encode(), np.uint8) - 48
        ahead = np.zeros(len(bits), np.int64)
        for j in range(width):
            ahead[: len(bits) - j] |= bits[j:].astype(np.int64) << (width - 1 - j)
        symbol, size = np.zeros(1 << width, np.int64), np.ones(1 << width, np.int64)
        for w, s in self.codes.items():
            low = int(w, 2) << (width - len(w))
            symbol[low : low + (1 << (width - len(w)))], size[low : low + (1 << (width - len(w)))] = s, len(w)
        symbols, sizes = symbol[ahead].tolist(), size[ahead].tolist()
        out, i, end = bytearray(), 0, len(sizes)
        while n and i < end:
            out.append(symbols[i])
            i += sizes[i]
            n -= 1
        self.src.at = at + i
        return bytes(out)


class Arithmetic(Fixed):
    """Static range coder for literals; other tokens at fixed width in a section of their own."""

    name = "arithmetic"

    def encoder(self, literals):
        return ArithmeticEncoder(literals)

    def decoder(self, data):
        return ArithmeticDecoder(data)


_TOP, _BOTTOM = 1 << 48, 1 << 40


def scaled(counts: list[int]) -> list[int]:
    """Cumulative counts whose total stays below the coder's smallest range; no symbol that occurs gets 0."""
    total = sum(counts)
    if total >= 1 << 24:
        counts = [max(1, c * ((1 << 23) - 256) // total) if c else 0 for c in counts]
    out = [0]
    for c in counts:
        out.append(out[-1] + c)
    return out


class ArithmeticEncoder(FixedEncoder):
    def __init__(self, literals):
        super().__init__(literals)
        counts = np.bincount(np.frombuffer(bytes(literals), np.uint8), minlength=256).tolist()
        self.counts, self.sums = counts, scaled(counts)
        self.low, self.range, self.bytes, self.n = 0, _TOP, bytearray(), 0

    def lit(self, c):
        self.lits((c,))

    def lits(self, data):
        low, wide, out, sums, total = self.low, self.range, self.bytes, self.sums, self.sums[-1]
        own = [b - a for a, b in zip(sums, sums[1:])]
        for c in data:
            step = wide // total
            low += step * sums[c]
            wide = step * own[c]
            if low >= _TOP:  # carry
                low -= _TOP
                i = len(out) - 1
                while out[i] == 255:
                    out[i] = 0
                    i -= 1
                out[i] += 1
            while wide < _BOTTOM:
                out.append(low >> 40)
                low = (low << 8) & (_TOP - 1)
                wide <<= 8
        self.low, self.range = low, wide
        self.n += len(data)

    def done(self):
        head = BitWriter()
        head.compressed(self.n)
        head.compressed(sum(c > 0 for c in self.counts))
        for s, c in enumerate(self.counts):
            if c:
                head.write(s, 8)
                head.compressed(c)
        if self.n:
            self.bytes += self.low.to_bytes(6, "big")
        h, body = head.done(), self.out.done()
        return len(h).to_bytes(4, "big") + h + len(self.bytes).to_bytes(4, "big") + bytes(self.bytes) + body


class ArithmeticDecoder(FixedDecoder):
    def __init__(self, data):
        if not data:
            super().__init__(b"")
            self.left = 0
            return
        n = int.from_bytes(data[:4], "big")
        head = BitReader(data[4 : 4 + n])
        at = 4 + n
        size = int.from_bytes(data[at : at + 4], "big")
        self.bytes, self.at = data[at + 4 : at + 4 + size], 6
        super().__init__(data[at + 4 + size :])
        self.left = head.compressed()
        counts = [0] * 256
        for _ in range(head.compressed()):
            s = head.read(8)
            counts[s] = head.compressed()
        self.sums = scaled(counts)
        self.total = self.sums[-1]
        # The symbol of each sum, unless a table for that is longer than what is read with it.
        self.table = np.repeat(np.arange(256, dtype=np.uint8), np.diff(self.sums)).tobytes() if self.total <= max(self.left, 1 << 10) else None
        self.code, self.range = int.from_bytes(self.bytes[:6].ljust(6, b"\0"), "big"), _TOP

    def eof(self):
        return self.left <= 0 and super().eof()

    def rest(self):
        return self.lits(self.left)

    def lit(self):
        return self.lits(1)[0]

    def lits(self, n):
        if not n:
            return b""
        code, wide, src, at, sums, total, table, out = self.code, self.range, self.bytes, self.at, self.sums, self.total, self.table, bytearray()
        for _ in range(n):
            step = wide // total
            k = code // step
            if k >= total:
                k = total - 1
            s = table[k] if table is not None else bisect_right(sums, k) - 1
            low = sums[s]
            code -= step * low
            wide = step * (sums[s + 1] - low)
            while wide < _BOTTOM:
                code = code << 8 | (src[at] if at < len(src) else 0)
                at += 1
                wide <<= 8
            out.append(s)
        self.code, self.range, self.at = code, wide, at
        self.left -= n
        return bytes(out)


class LowEntropy(Fixed):
    """Static low-entropy code ("sle"): literals and frequent k-mers ranked by count, short codes for low ranks."""

    name = "sle"

    def __init__(self, kmer: int = 3):
        if not 1 <= kmer <= 7:
            raise ValueError("kmer must be from 1 to 7")
        self.kmer = kmer

    def encoder(self, literals):
        return LowEntropyEncoder(literals, self.kmer)

    def decoder(self, data):
        return LowEntropyDecoder(data, self.kmer)


#: (ranks, prefix, offset, width) of the classes by the bits that the alphabet needs; None: the full width.
def rank_classes(bits: int) -> list[tuple[int, str, int, int | None]]:
    if bits < 4:
        return [(1 << 62, "", 0, None)]
    if bits < 6:
        return [(4, "0", 0, 2), (1 << 62, "1", 0, None)]
    if bits == 6:
        return [(8, "00", 0, 3), (16, "01", 8, 3), (32, "10", 16, 4), (1 << 62, "11", 0, None)]
    steps = [(4 * i + 4, format(i, "03b"), 4 * i, 2) for i in range(4)] + [(8 * i + 24, format(i + 4, "03b"), 8 * i + 16, 3) for i in range(3)]
    return [*steps, (1 << 62, "111", 0, None)]


MIND = [(8, "00", 0, 3), (16, "01", 8, 3), (32, "10", 16, 4), (1 << 62, "11", 0, None)]


MIND_CLASSES = {p: (b, w) for _, p, b, w in MIND}


def ranking(literals: bytes, k: int) -> list[bytes]:
    """Symbols (bytes and k-mers) by count, then bytes before k-mers, then value."""
    single = Counter(literals)
    symbols = [(n, bytes([s])) for s, n in single.items()]
    if k > 1 and single:
        sigma = len(single)
        bits = bits_for(sigma - 1)
        eta = (1 << (bits + (1 if 1 << bits == sigma else 2))) - sigma
        data, m = np.frombuffer(literals, np.uint8).astype(np.int64), len(literals) - k + 1
        code = np.zeros(max(m, 0), np.int64)
        for j in range(k if m > 0 else 0):
            code = code << 8 | data[j : j + m]
        grams, times = np.unique(code, return_counts=True)
        first = np.argsort(-times, kind="stable")[:eta]
        symbols += [(n, g.to_bytes(k, "big")) for g, n in zip(grams[first].tolist(), times[first].tolist())]
    return [s for _, s in sorted(symbols, key=lambda x: (-x[0], len(x[1]), x[1]))]


def rank_words(width: int, count: int) -> list[str]:
    """The words of the first ranks."""
    out, classes = [], iter(rank_classes(width))
    end = 0
    for r in range(count):
        while r >= end:
            end, prefix, base, w = next(classes)
        out.append(prefix + format(r - base, f"0{w or width}b"))
    return out


class LowEntropyEncoder(FixedEncoder):
    def __init__(self, literals, k):
        super().__init__(literals)
        order = ranking(bytes(literals), k)
        self.k, self.held = k, b""
        self.width = bits_for(max(0, len(order) - 1))
        self.out.compressed(len(order))
        self.out.text("".join([SEVENS[int.from_bytes(s, "big") << 1 | (len(s) > 1)] for s in order]))
        self.words = dict(zip(order, rank_words(self.width, len(order))))
        grams = sorted(int.from_bytes(s, "big") for s in order if len(s) == k) if k > 1 else []
        self.grams = np.array(grams, np.int64)
        self.single = {s[0]: w for s, w in self.words.items() if len(s) == 1}

    def symbol(self, s: bytes) -> None:
        self.out.text(self.words[s])

    def flush(self) -> None:
        for c in self.held:
            self.symbol(bytes([c]))
        self.held = b""

    def lit(self, c):
        self.held += bytes([c])
        if self.k == 1:
            return self.flush()
        if len(self.held) > self.k:
            self.symbol(self.held[:1])
            self.held = self.held[1:]
        if len(self.held) == self.k and self.held in self.words:
            self.symbol(self.held)
            self.held = b""

    def lits(self, data):
        held, k, words, out, i = self.held + bytes(data), self.k, self.words, [], 0
        n = len(held)
        if n >= 128 and k > 1:  # where k-mers that have words begin, found for all places at once
            a = np.frombuffer(held, np.uint8).astype(np.int64)
            code = np.zeros(n - k + 1, np.int64)
            for j in range(k):
                code = code << 8 | a[j : n - k + 1 + j]
            at = np.searchsorted(self.grams, code)
            at[at == len(self.grams)] = 0
            find, single = (self.grams[at] == code if len(self.grams) else code < 0).tobytes().find, self.single.__getitem__
            while (hit := find(1, i)) >= 0:
                out += map(single, held[i:hit])
                i = hit + k
                out.append(words[held[hit:i]])
            last = max(i, n - k + 1)  # the last ones wait for what follows
            out += map(single, held[i:last])
            i = last
        while n - i >= k:
            w = words.get(held[i : i + k])
            if w is None:
                w = words[held[i : i + 1]]
                i += 1
            else:
                i += k
            out.append(w)
        self.held = held[i:]
        self.out.text("".join(out))

    def bit(self, b):
        self.flush()
        super().bit(b)

    def num(self, v, low, high):
        self.flush()
        super().num(v, low, high)

    def mind(self, v, low, high):
        self.flush()
        width, v = bits_for(high - low), v - low
        if width <= 5:
            return self.out.write(v, width)
        _, prefix, base, w = next(c for c in MIND if v < c[0])
        self.out.text(prefix)
        self.out.write(v - base, w or width)

    def done(self):
        self.flush()
        return super().done()


@cache
def rank_pattern(width: int) -> re.Pattern:
    """Finds the next word of a rank."""
    return re.compile("|".join(f"{prefix}[01]{{{w or width}}}" for _, prefix, _, w in rank_classes(width)))


class LowEntropyDecoder(FixedDecoder):
    def __init__(self, data, k):
        super().__init__(data)
        self.ready: list[int] = []
        self.words, self.pattern, self.longest = {}, None, 1
        if self.src.eof():
            return
        # The numbers of the header are whole bytes.
        n, at = read_vbyte(data, 0)
        order = []
        for _ in range(n):
            v, at = read_vbyte(data, at)
            order.append((v >> 1).to_bytes(k if v & 1 else 1, "big"))
        self.src.at = 8 * at
        width = bits_for(max(0, n - 1))
        self.words = dict(zip(rank_words(width, n), order))
        self.pattern = rank_pattern(width)
        self.longest = max(map(len, self.words), default=1)

    def eof(self):
        return not self.ready and super().eof()

    def pick(self, classes: dict, sizes: list[int], full: int) -> int:
        src = self.src
        for n in sizes:
            found = classes.get(src.bits[src.at : src.at + n])
            if found is not None:
                src.at += n
                return found[0] + src.read(found[1] or full)
        raise ValueError("not a code of this coder")

    def symbol(self) -> bytes:
        word = self.pattern.match(self.src.bits, self.src.at)[0]
        self.src.at += len(word)
        return self.words[word]

    def lit(self):
        if not self.ready:
            self.ready = list(self.symbol())[::-1]
        return self.ready.pop()

    def rest(self):
        found = self.pattern.findall(self.src.bits, self.src.at) if self.pattern else []
        out = bytes(self.ready[::-1]) + b"".join(map(self.words.__getitem__, found))
        self.ready, self.src.at = [], len(self.src.bits)
        return out

    def lits(self, n):
        out = bytearray()
        while len(out) < n:
            if self.ready:
                out.append(self.ready.pop())
                continue
            if n - len(out) >= 16:  # so many words at least, as none has more than 7 bytes
                at = self.src.at
                found = self.pattern.findall(self.src.bits, at, at + (n - len(out)) // 7 * self.longest)[: (n - len(out)) // 7]
                self.src.at += sum(map(len, found))
                out += b"".join(map(self.words.__getitem__, found))
                continue
            s = self.symbol()
            room = n - len(out)
            out += s[:room]
            self.ready = list(s[room:])[::-1]
        return bytes(out)

    def mind(self, low, high):
        width = bits_for(high - low)
        if width <= 5:
            return self.src.read(width) + low
        return low + self.pick(MIND_CLASSES, [2], width)


class Two(Fixed):
    """Literals by one coder and numbers by another, in one stream; neither may hold tokens back."""

    name = "two"

    def __init__(self, literals: Fixed, numbers: Fixed):
        self.literals, self.numbers = literals, numbers

    def encoder(self, literals):
        e, n = self.literals.encoder(literals), self.numbers.encoder(b"")
        n.out = e.out
        if isinstance(n, UniversalEncoder):
            n.code = getattr(e.out, self.numbers.name)
        e.num, e.mind = n.num, n.mind
        return e

    def decoder(self, data):
        d, n = self.literals.decoder(data), self.numbers.decoder(b"")
        n.src = d.src
        if isinstance(n, UniversalDecoder):
            n.code = getattr(d.src, self.numbers.name)
        d.num, d.mind = n.num, n.mind
        return d


CODERS = {
    "bit": Fixed, "ascii": Ascii, "gamma": lambda: Universal("gamma"), "delta": lambda: Universal("delta"), "ternary": lambda: Universal("ternary"),
    "huff": Huffman, "arithmetic": Arithmetic, "sle": LowEntropy,
}
