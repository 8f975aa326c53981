"""Lempel-Ziv factorizations, each with its token stream and its inverse."""

from __future__ import annotations

import heapq

import numpy as np

from ..functions.bits import read_vbyte, vbyte
from .index import neighbours, of
from .transforms import escape, unescape

Factor = tuple[int, int, int]


def window_factors(data: bytes, window: int = 16, least: int = 3) -> list[Factor]:
    """(pos, src, len) of the leftmost longest match within the window before each position; a match is at most a window long."""
    out, i, n, find = [], 0, len(data), data.find
    while i < n:
        low, best, src, size = max(0, i - window), 0, -1, least
        while size <= window and i + size <= n:
            p = find(data[i : i + size], low, i + size - 1)
            if p < 0:
                break
            best, src, low = size, p, p
            size += 1
        if best:
            out.append((i, src, best))
            i += best
        else:
            i += 1
    return out


def lcp_factors(data: bytes, least: int = 3) -> list[Factor]:
    """Greedy left-to-right parse by the longest earlier factor, exact; the previous smaller suffix wins ties."""
    x = of(data)
    (sp, lp), (sn, ln) = neighbours(x.sa, x.lcp)
    take = lp >= ln
    src, size = np.where(take, sp, sn).tolist(), np.where(take, lp, ln).tolist()
    out, i = [], 0
    while i + 1 < len(data):
        if size[i] >= least:
            out.append((i, src[i], size[i]))
            i += size[i]
        else:
            i += 1
    return out


def replace_largest(data: bytes, least: int, strategy: str) -> list[Factor]:
    """Replace the longest common prefix first, anywhere; references may point forward.

    ``heap`` and ``arrays`` settle ties by suffix rank, ``bheap`` by text
    position, ``max_lcp`` takes the one met last.
    """
    x = of(data)
    sa, isa, lcp = x.sa.tolist(), x.isa.tolist(), x.lcp.tolist()
    out: list[Factor] = []

    def use(i: int) -> None:
        target, size = sa[i], lcp[i]
        out.append((target, sa[i - 1], size))
        for k in range(size):
            lcp[isa[target + k]] = 0
        for k in range(1, min(size, target) + 1):
            r = isa[target - k]
            if lcp[r] > k:
                lcp[r] = k

    if strategy in ("heap", "bheap"):
        tie = (lambda i: i) if strategy == "heap" else (lambda i: sa[i])
        heap = [(-v, tie(i), i) for i, v in enumerate(lcp) if v >= least]
        heapq.heapify(heap)
        while heap:
            v, t, i = heapq.heappop(heap)
            if lcp[i] < -v:
                if lcp[i] >= least:
                    heapq.heappush(heap, (-lcp[i], t, i))
            else:
                use(i)
        return out
    most = max(lcp, default=0)
    buckets: list[list[int]] = [[] for _ in range(most + 1)]
    for i, v in enumerate(lcp):
        if v >= least:
            buckets[v].append(i)
    for v in range(most, least - 1, -1):
        bucket, at = buckets[v], 0
        while bucket if strategy == "max_lcp" else at < len(bucket):
            i = bucket.pop() if strategy == "max_lcp" else bucket[at]
            at += 1
            if lcp[i] == v:
                use(i)
            elif least <= lcp[i] < v:
                buckets[lcp[i]].append(i)
    return out


def peaks(data: bytes, least: int) -> list[Factor]:
    """One scan over the permuted LCP array that replaces at its local peaks."""
    x = of(data)
    plcp, phi, n = x.plcp.tolist(), x.phi.tolist(), x.n
    out, i, after = [], 0, True
    while i + 1 < n:
        v = plcp[i]
        if v >= least and v > plcp[i + 1] and (after or v > plcp[i - 1]):
            out.append((i, phi[i], v))
            i, after = i + v, True
        else:
            i, after = i + 1, False
    return out


def local_heaps(data: bytes, least: int) -> list[Factor]:
    """Left to right with a heap of points of interest, the longest (then leftmost) of which is replaced first.

    A point joins while the points before it reach it and its permuted LCP is above theirs; at the end of the
    last one the heap is emptied: points to the left of a factor are shortened to end before it, points inside
    it go, and what they cover to the right of it becomes a new point.  As in the reference, points still
    waiting when the text ends stay literals.
    """
    x = of(data)
    plcp, phi, n = x.plcp.tolist(), x.phi.tolist(), x.n
    out: list[Factor] = []
    # By place in the text: position and length, 0 if gone.
    pos: list[int] = []
    size: list[int] = []

    def settle(now: int) -> None:
        heap = [(-v, p, k) for k, (p, v) in enumerate(zip(pos, size))]
        heapq.heapify(heap)
        while heap:
            v, p, k = heapq.heappop(heap)
            if size[k] != -v or pos[k] != p:
                continue
            out.append((p, phi[p], -v))
            size[k], after = 0, p - v
            if after < now:
                left, met = 0, False
                for j in range(k + 1, len(pos)):
                    if not size[j]:
                        continue
                    if pos[j] >= after:
                        met = pos[j] == after
                        break
                    left, size[j] = max(left, pos[j] + size[j] - after), 0
                if not met and left >= least:
                    pos[k + 1], size[k + 1] = after, left
                    heapq.heappush(heap, (-left, after, k + 1))
            for j in range(k - 1, -1, -1):
                if not size[j]:
                    continue
                if p - pos[j] >= size[j]:
                    break
                size[j] = p - pos[j] if p - pos[j] >= least else 0
                if size[j]:
                    heapq.heappush(heap, (-size[j], pos[j], j))
        pos.clear()
        size.clear()

    for i in range(n - 1):
        if pos and i - pos[-1] >= size[-1]:
            settle(i)
        if plcp[i] >= least if not pos else plcp[i] > size[-1]:
            pos.append(i)
            size.append(plcp[i])
    return out


def scan(data: bytes, least: int) -> list[Factor]:
    """Left to right: replace wherever the permuted LCP reaches the threshold."""
    x = of(data)
    plcp, phi = x.plcp.tolist(), x.phi.tolist()
    out, i = [], 0
    while i + 1 < x.n:
        if plcp[i] >= least:
            out.append((i, phi[i], plcp[i]))
            i += plcp[i]
        else:
            i += 1
    return out


def lcpcomp_factors(data: bytes, least: int = 5, comp: str = "arrays", flatten: bool = True) -> list[Factor]:
    if comp == "plcppeaks":
        out = peaks(data, least)
    elif comp == "plcp":
        out = local_heaps(data, least)
    elif comp == "naive":
        out = scan(data, least)
    else:
        out = replace_largest(data, least, comp)
    out.sort()
    return flattened(out)[0] if flatten else out


def flattened(factors: list[Factor]) -> tuple[list[Factor], int]:
    """Point each factor past factors that wholly cover its source; also the longest chain that was cut."""
    if not factors:
        return [], 0
    pos = np.array([f[0] for f in factors])
    size = np.array([f[2] for f in factors])
    src, own = np.array([f[1] for f in factors]), np.array([f[1] for f in factors])
    depth, limit = 0, len(factors)
    while depth < limit:
        at = np.searchsorted(pos, src, "right") - 1
        safe = np.maximum(at, 0)
        inside = (at >= 0) & (src + size <= pos[safe] + size[safe])
        if not inside.any():
            break
        src = np.where(inside, own[safe] + src - pos[safe], src)
        depth += 1
    return list(zip(pos.tolist(), src.tolist(), size.tolist())), depth


def literals_of(data: bytes, factors: list[Factor]) -> bytes:
    out, at = [], 0
    for pos, _, size in factors:
        out.append(data[at:pos])
        at = pos + size
    return b"".join([*out, data[at:]])


def resolve(n: int, factors: list[Factor], literals: bytes) -> bytes:
    """Expand references of any direction by pointer jumping over positions."""
    jump = np.arange(n)
    if factors:
        pos, src, size = np.array(factors, np.int64).T
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        jump[np.repeat(pos, size) + within] = np.repeat(src, size) + within
    text = np.zeros(n, np.uint8)
    text[jump == np.arange(n)] = np.frombuffer(literals, np.uint8)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return text[jump].tobytes()
        jump = further


def put_factors(coder, data: bytes, factors: list[Factor]) -> bytes:
    """Header (size, shortest, longest, widest gap), then gap, literals, source and length of each factor, then the rest."""
    n = len(data)
    e = coder.encoder(literals_of(data, factors))
    short = min((f[2] for f in factors), default=0)
    long = max((f[2] for f in factors), default=0)
    gaps, at = [], 0
    for pos, _, size in factors:
        gaps.append(pos - at)
        at = pos + size
    wide = max(gaps, default=0)
    for v in (n, len(factors), short, long, wide):
        e.num(v, 0, (1 << 32) - 1)
    at = 0
    for (pos, src, size), gap in zip(factors, gaps):
        e.bit(gap > 0)
        if gap:
            e.num(gap, 0, wide)
            e.lits(data[at:pos])
        e.num(src, 0, n)
        e.mind(size, short, long)
        at = pos + size
    e.lits(data[at:])
    return e.done()


def get_factors(coder, data: bytes) -> bytes:
    d = coder.decoder(data)
    n, count, short, long, wide = (d.num(0, (1 << 32) - 1) for _ in range(5))
    factors, literals, at = [], [], 0
    for _ in range(count):
        gap = d.num(0, wide) if d.bit() else 0
        literals.append(d.lits(gap))
        src = d.num(0, n)
        size = d.mind(short, long)
        factors.append((at + gap, src, size))
        at += gap + size
    literals.append(d.lits(n - at))
    return resolve(n, factors, b"".join(literals))


def lzss(data: bytes, coder, window: int = 16, threshold: int = 3) -> bytes:
    factors = window_factors(data, window, threshold)
    e, at = coder.encoder(literals_of(data, factors)), 0
    for pos, src, size in [*factors, (len(data), 0, 0)]:
        for i in range(at, pos):
            e.bit(0)
            e.lit(data[i])
        if size:
            e.bit(1)
            e.num(pos - src, 0, pos)
            e.num(size, 0, window)
        at = pos + size
    return e.done()


def unlzss(data: bytes, coder, window: int = 16, threshold: int = 3) -> bytes:
    d, out = coder.decoder(data), bytearray()
    while not d.eof():
        if d.bit():
            src = len(out) - d.num(0, len(out))
            size = d.num(0, window)
            for k in range(size):
                out.append(out[src + k])
        else:
            out.append(d.lit())
    return bytes(out)


def lzss_lcp(data: bytes, coder, threshold: int = 3) -> bytes:
    text = escape(data)
    return put_factors(coder, text, lcp_factors(text, threshold))


def lcpcomp(data: bytes, coder, comp: str = "arrays", threshold: int = 5, flatten: bool = True) -> bytes:
    text = escape(data)
    return put_factors(coder, text, lcpcomp_factors(text, threshold, comp, flatten))


def unfactor(data: bytes, coder, **_) -> bytes:
    return unescape(get_factors(coder, data))


def lz78_factors(data: bytes, dict_size: int = 0) -> list[tuple[int, int]]:
    """(reference, byte); the dictionary starts anew when it holds ``dict_size`` phrases (0: never)."""
    out, trie, node, parent = [], {}, 0, 0
    for c in data:
        child = trie.get((node, c))
        if child is None:
            out.append((node, c))
            trie[node, c] = len(trie) + 1
            node = 0
            if dict_size and len(trie) >= dict_size:
                trie = {}
        else:
            parent, node = node, child
    if node:
        out.append((parent, data[-1]))
    return out


def lz78(data: bytes, coder, dict_size: int = 0) -> bytes:
    factors = lz78_factors(data, dict_size)
    e = coder.encoder(bytes(c for _, c in factors))
    for z, (ref, c) in enumerate(factors):
        e.num(ref, 0, z % dict_size if dict_size else z)
        e.lit(c)
    return e.done()


def unlz78(data: bytes, coder, dict_size: int = 0) -> bytes:
    d, phrases, out, z = coder.decoder(data), [b""], [], 0
    while not d.eof():
        if dict_size and z and z % dict_size == 0:
            phrases = [b""]
        ref = d.num(0, z % dict_size if dict_size else z)
        phrase = phrases[ref] + bytes([d.lit()])
        phrases.append(phrase)
        out.append(phrase)
        z += 1
    return b"".join(out)


def lzw_codes(data: bytes, dict_size: int = 0) -> list[int]:
    out, trie, node = [], {}, -1
    for c in data:
        if node < 0:
            node = c
            continue
        child = trie.get((node, c))
        if child is None:
            out.append(node)
            trie[node, c] = 256 + len(trie)
            node = c
            if dict_size and len(trie) >= dict_size:
                trie = {}
        else:
            node = child
    return out + [node] if node >= 0 else out


def lzw(data: bytes, coder, dict_size: int = 0) -> bytes:
    e, codes = coder.encoder(b""), lzw_codes(data, dict_size)
    e.nums(codes, [256 + (z % dict_size if dict_size else z) for z in range(len(codes))])
    return e.done()


def unlzw(data: bytes, coder, dict_size: int = 0) -> bytes:
    d, out, z = coder.decoder(data), [], 0
    base = [bytes([i]) for i in range(256)]
    phrases, last = list(base), b""
    while not d.eof():
        fresh = dict_size and z and z % dict_size == 0
        code = d.num(0, 256 + (z % dict_size if dict_size else z))
        if fresh:
            phrases, last = list(base), b""
        if code < len(phrases):
            phrase = phrases[code]
        else:  # the phrase that is just being made
            phrase = last + last[:1]
        if last:
            phrases.append(last + phrase[:1])
        out.append(phrase)
        last = phrase
        z += 1
    return b"".join(out)


class SuffixTree:
    """Internal nodes are common-prefix intervals: parent, string depth, and the path of any suffix."""

    def __init__(self, data: bytes):
        x = of(data)
        self.sa, self.isa, n = x.sa.tolist(), x.isa.tolist(), x.n
        lcp = [*x.lcp.tolist()[1:], 0]  # lcp[i]: of the suffixes i and i + 1
        self.depth, self.parent, self.leaf_parent = [0], [-1], [0] * n
        stack = [0]
        for i in range(n):
            v, last = lcp[i] if i + 1 < n else 0, -1
            before = lcp[i - 1] if i else 0
            if v > before:
                node = len(self.depth)
                self.depth.append(v)
                self.parent.append(stack[-1])
                stack.append(node)
                self.leaf_parent[i] = node
                continue
            self.leaf_parent[i] = stack[-1]
            while self.depth[stack[-1]] > v:
                last = stack.pop()
                if self.depth[stack[-1]] < v:
                    node = len(self.depth)
                    self.depth.append(v)
                    self.parent.append(stack[-1])
                    self.parent[last] = node
                    stack.append(node)
                    break

    def path(self, pos: int) -> list[int]:
        """Nodes from below the root down to the parent of the leaf of suffix ``pos``."""
        out, node = [], self.leaf_parent[self.isa[pos]]
        while node > 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def lz78u_factors(data: bytes) -> list[Factor]:
    """(begin, end, reference): the label is data[begin:end]; a phrase is a whole suffix-tree edge below its reference.

    The edge to a leaf counts for its first byte only.
    """
    tree, phrase, out, pos, n = SuffixTree(data), {}, [], 0, len(data)
    while pos + 1 < n:
        ref, done, end = 0, 0, -1
        for node in tree.path(pos):
            if node not in phrase:
                end = tree.depth[node]
                phrase[node] = len(out) + 1
                break
            ref, done = phrase[node], tree.depth[node]
        if end < 0:  # all inner nodes are taken: a byte of the edge to the leaf
            end = done + 1
        end = min(end, n - 1 - pos)
        if end <= done:  # the text ends inside the path: its last byte stands alone
            ref, done, end = 0, 0, 1
        out.append((pos + done, pos + end, ref))
        pos += end
    return out


def lz78u(data: bytes, coder, threshold: int = 3, string_coder=None) -> bytes:
    """Reference, then the label; labels of ``threshold`` bytes or more are named by an earlier place where there is one.

    Labels that are written out are a stream of their own, by ``string_coder``, after the references and their length.
    """
    text = escape(data)
    factors = lz78u_factors(text)
    rows = []
    for begin, end, ref in factors:
        src = text.find(text[begin:end], 0, begin) if end - begin >= threshold else -1
        rows.append((ref, begin, end, src))
    e, labels = coder.encoder(b""), b"".join(text[b:x] for _, b, x, s in rows if s < 0)
    for z, (ref, begin, end, src) in enumerate(rows):
        size = end - begin
        e.num(ref, 0, z)
        e.bit(src >= 0)
        e.num(min(size, 15), 0, 15)
        if size >= 15:
            e.num(size, 0, (1 << 32) - 1)
        if src >= 0:
            e.num(src, 0, begin)
    own = (string_coder or coder).encoder(labels)
    own.lits(labels)
    refs = e.done()
    return vbyte(len(refs)) + refs + own.done()


def unlz78u(data: bytes, coder, threshold: int = 3, string_coder=None) -> bytes:
    size, at = read_vbyte(data, 0)
    d, own, phrases, out = coder.decoder(data[at : at + size]), (string_coder or coder).decoder(data[at + size :]), [b""], bytearray()
    while not d.eof():
        ref = d.num(0, len(phrases) - 1)
        known, size = d.bit(), d.num(0, 15)
        if size == 15:
            size = d.num(0, (1 << 32) - 1)
        head = phrases[ref]
        begin = len(out) + len(head)
        out += head
        label = bytes(out[(s := d.num(0, begin)) : s + size]) if known else own.lits(size)
        out += label
        phrases.append(head + label)
    return unescape(bytes(out) + b"\0")
