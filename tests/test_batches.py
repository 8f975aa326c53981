"""What runs over many texts at once, against its definition one text at a time."""

import random
import time

from corpuspress.functions import coders
from corpuspress.operators import grammar, index, lz, transforms
from corpuspress.operators.suffixes import lcp_intervals
from corpuspress.plans import registry
from support import SF
from test_codecs import FIXED, WORDS, drawn

TEXTS = FIXED + WORDS + drawn(80) + [b"abcab" * 300, b"a" * 1000, bytes(random.Random(3).choice(b"abc") for _ in range(3000))]


def reduced(names):
    while max(names) > 5:
        fresh = [names[0] & 1]
        for a, b in zip(names, names[1:]):
            place = ((a ^ b) & -(a ^ b)).bit_length() - 1
            fresh.append(2 * place + (b >> place & 1) if a != b else 0)
        if max(fresh) >= max(names):
            break
        names = fresh
    return names


def even(n):
    return [n] if n == 1 else [2] * (n // 2) if n % 2 == 0 else [2] * (n // 2 - 1) + [3]


def cuts(s):
    parts, i = [], 0
    while i < len(s):
        j = i + 1
        if j < len(s) and s[j] == s[i]:
            while j < len(s) and s[j] == s[i]:
                j += 1
            parts.append([i, j, True])
        else:
            while j < len(s) and not (j + 1 < len(s) and s[j] == s[j + 1]):
                j += 1
            parts.append([i, j, False])
        i = j
    joined = []
    for a, b, same in parts:
        if joined and 1 in (b - a, joined[-1][1] - joined[-1][0]):
            joined[-1][1:] = [b, False]
        else:
            joined.append([a, b, same])
    sizes = []
    for a, b, same in joined:
        at, n = 0, b - a
        if not same and n >= 4:
            names = reduced(s[a:b])
            for i in range(2, n - 1):
                if i - at >= 2 and names[i] > names[i - 1] and names[i] >= names[i + 1]:
                    sizes += even(i - at)
                    at = i
        sizes += even(n - at)
    return sizes


def parsed(data):
    if not data:
        return -1, []
    s, known = list(data), {}
    name = lambda a, b: known.setdefault((a, b), 256 + len(known))
    while len(s) > 1:
        out, at = [], 0
        for n in cuts(s):
            x = s[at]
            for y in s[at + 1 : at + n]:
                x = name(x, y)
            out.append(x)
            at += n
        s = out
    return s[0], list(known)


def test_edit_sensitive_parses_of_many_texts():
    for found, data in zip(grammar.esp_grammars(TEXTS), TEXTS, strict=True):
        assert (found[0], list(map(tuple, found[1].tolist()))) == parsed(data), data


def test_many_texts_have_the_blobs_of_single_ones():
    for algorithm in ("esp", "esp(plain)", *(f"esp(sorted({d}))" for d in grammar.ARRAYS), "esp(sorted(succinct(subseq=greedy)))", "encode(huff)"):
        c = registry.codec(algorithm)
        blobs = c.forward_all(TEXTS)
        assert blobs == [c.forward(t) for t in TEXTS] and c.backward_all(blobs) == TEXTS, algorithm


def test_rules_of_parses(spark):
    from corpuspress import queries

    docs = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(TEXTS)] + [(-1, None)], "doc_id bigint, text binary")
    from corpuspress.operators import relations

    found = {}
    for r in relations.slp_rules(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["sym"], r["l"], r["r"]))
    assert {i: sorted(v) for i, v in found.items()} == {i: [(256 + k, *r) for k, r in enumerate(parsed(t)[1])] for i, t in enumerate(TEXTS) if parsed(t)[1]}
    assert queries.QUERIES["slp_rules"](spark, SF).count() > 0


def substitutions(data, least):
    """Common-prefix intervals, each tried at its depth and one byte shorter each time it fails."""
    x = lz.of(data)
    lcp, sa = [*x.lcp.tolist(), 0], x.sa.tolist()
    heap = [(-d, min(sa[a : b + 1]) if b - a < 64 else sa[a], a, b) for a, b, d in zip(*(v.tolist() for v in lcp_intervals(x.lcp, least)))]
    taken, rules, found = [0] * len(data), [], []
    while heap:
        d, first, a, b = heap.pop(heap.index(min(heap)))
        free, last = [], -1
        for p in sorted(sa[a : b + 1]):
            if p >= last and not any(taken[p : p - d]):
                free.append(p)
                last = p - d
        if len(free) > 1:
            for p in free:
                taken[p : p - d] = [1] * -d
                found.append((p, len(rules)))
            rules.append((free[0], -d))
        elif -d - 1 > max(least - 1, lcp[a], lcp[b + 1]):
            heap.append((d + 1, first, a, b))
    return rules, sorted(found)


def test_longest_first_by_its_definition():
    for data in [b"abcdebcdeabc\0", b"a" * 200 + b"\0", b"abaaabbababb\0", b"abc" * 90 + b"\0", *(t + b"\0" for t in drawn(60, 11) if b"\0" not in t)]:
        assert grammar.longest_first(data) == substitutions(data, 2), data


def test_longest_first_of_periodic_texts():
    began = time.process_time()
    for data in (b"Titionly.\nErheed. " * 6000, b"a" * 100_000):
        start, rules = grammar.lfs_grammar(data)
        assert grammar.expand(start, [tuple(r) for r in rules]).startswith(data)
    assert time.process_time() - began < 60


def test_words_of_universal_and_low_entropy_codes():
    for name in ("gamma", "delta", "ternary"):
        pattern, words, longest = coders.byte_words(name)
        assert sorted(words.values()) == list(range(256)) and max(map(len, words)) == longest
        assert all(pattern.findall(a + b) == [a, b] for a in words for b in list(words)[::37])
    for width in range(1, 12):
        words = coders.rank_words(width, 1 << width)
        assert len(set(words)) == 1 << width and coders.rank_pattern(width).findall("".join(words)) == words


def test_literals_in_parts():
    data = b"the heat of the earth, the heart of the hearth; " * 40
    for name in ("gamma", "delta", "ternary", "sle", "arithmetic", "huff", "bit"):
        coder = coders.CODERS[name]()
        e = coder.encoder(data)
        for at in range(0, len(data), 300):
            e.lits(data[at : at + 300])
        e.bit(1)
        d, out = coder.decoder(e.done()), b""
        for size in (1, 2, 15, 16, 17, 130, 700):
            out += d.lits(size)
            out += bytes([d.lit()])
        out += d.lits(len(data) - len(out))
        assert out == data and d.bit() == 1 and d.eof(), name


def test_packed_suffix_sorts():
    for data in (t for t in TEXTS if t):
        x, suffixes = index.of(data), sorted(range(len(data)), key=lambda i: data[i:])
        assert x.sa.tolist() == suffixes == transforms.suffix_array(data).tolist() and x.span == 6
        for i, (a, b) in enumerate(zip(suffixes, suffixes[1:]), 1):
            n = int(x.lcp[i])
            assert data[a : a + n] == data[b : b + n] and (max(a, b) + n == len(data) or data[a + n] != data[b + n])


def repaired(data):
    """The most frequent pair (counted from the left without overlaps, ties by pair), counted anew each time."""
    s, rules = list(data), []
    while True:
        places, last = {}, {}
        for i, pair in enumerate(zip(s, s[1:])):
            if last.get(pair, -2) < i - 1 or pair[0] != pair[1]:
                places.setdefault(pair, []).append(i)
                last[pair] = i
        pair = min(places, key=lambda p: (-len(places[p]), p), default=None)
        if pair is None or len(places[pair]) < 2:
            return s, rules
        for i in places[pair][::-1]:
            s[i : i + 2] = [256 + len(rules)]
        rules.append(pair)


def test_repair_by_its_definition():
    for data in (t for t in TEXTS if len(t) < 700):
        assert grammar.repair_grammar(data) == repaired(data), data
