import random

import pytest

from corpuspress.functions import bits, coders
from corpuspress.operators import grammar, lz, transforms
from corpuspress.plans import registry
from corpuspress.sources import generators

FIXED = [
    b"", b"a", b"aaaaaaaaa", b"banana", b"ananas", b"abcdebcdeabc", b"abcdefgh#defgh_abcde", b"abcabcabcabc", b"abaaabbababb", b"ABBCBCABA", b"abbbbbbbbbbcbbbbbbbbbb",
    bytes(range(256)), b"\0", b"\0\0a\xff\xff\xfe", b"\xff" * 5, "Съешь ещё этих мягких булок".encode(), "いろはにほへと ちりぬるを".encode(), "ξεσκεπάζω τὴν ψυχοφθόρα".encode(), "เป็นมนุษย์สุดประเสริฐ".encode(),
]
WORDS = [generators.fibonacci(n) for n in range(1, 15)] + [generators.thue_morse(n) for n in range(9)] + [generators.run_rich(n) for n in range(8)] + [generators.uniform(1 << i, i) for i in range(9)]


def drawn(n=60, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        size, letters = rng.choice([0, 1, 2, 3, 5, 17, 60, 300]), rng.choice([b"ab", b"abcd\0", bytes(range(256)), b"a"])
        out.append(bytes(rng.choice(letters) for _ in range(size)))
    return out


@pytest.mark.parametrize("algorithm", [
    "noop", "rle", "rle(offset=3)", "mtf", "bwt", "escape", "encode(bit)", "encode(ascii)", "encode(gamma)", "encode(delta)", "encode(ternary)", "encode(huff)", "encode(arithmetic)", "encode(sle)", "encode(sle(1))",
    "bwt:rle:mtf:encode(huff)", "lzss(bit)", "lzss(huff, 32, 4)", "lzss_lcp(sle)", "lz78(ascii)", "lz78(bit, dict_size=7)", "lzw(bit)", "lzw(gamma, dict_size=9)", "lz78u(coder=huff)", "repair(sle)", "repair(bit, 3)",
    *(f"lcpcomp(coder=sle, comp={c}, threshold=3)" for c in registry.STRATEGIES), "lcpcomp(flatten=false)", "esp", "esp(plain)", *(f"esp(sorted({d}))" for d in grammar.ARRAYS), "lfs_comp(st)", "lfs2", "lfs2bst(2)",
])
def test_round_trip(algorithm):
    c = registry.codec(algorithm)
    for s in FIXED + WORDS + drawn():
        assert c.backward(c.forward(s)) == s, s


def test_goldens():
    assert transforms.bwt(b"aaababaaabaababa") == b"abb\0ababbaaaaaaaa"
    assert transforms.escape(bytes([0, 1, 255, 254, 0])) == bytes.fromhex("fffe01fffffefffe00")
    forward = lambda a, s: registry.codec(a).forward(s)
    assert forward("lz78(ascii)", b"aababcabcdabcde") == b"0:a1:b2:c3:d4:e\0"
    assert forward("lz78(ascii)", b"aababcabcdabcdeabc") == b"0:a1:b2:c3:d4:e2:c\0"
    assert forward("lzw(ascii)", b"aaaaaa") == b"97:256:257:\0"
    assert forward("lzw(ascii)", b"aaaaaaa") == b"97:256:257:97:\0"
    assert forward("lzw(ascii)", b"\xff\xff\xff") == b"255:256:\0"
    assert lz.lz78u_factors(b"aaababaaabaababa\0") == [(0, 1, 0), (2, 3, 1), (3, 5, 0), (7, 8, 3), (9, 11, 1), (14, 16, 5)]
    table = coders.canonical(coders.code_lengths({97: 4, 98: 3, 99: 2}))
    assert (len(table[97]), len(table[98]), len(table[99])) == (1, 2, 2)
    layer = grammar.increasing([2, 3, 2, 8, 0, 5, 1, 3, 6, 6, 0, 4, 4, 1, 6])
    assert len(layer) == 6


def test_literals_and_decoding():
    text, factors = b"a__b____cd___e", [(1, 0, 2), (4, 0, 4), (10, 0, 3)]
    assert lz.literals_of(text, factors) == b"abcde"
    assert lz.resolve(12, [(1, 3, 3), (6, 0, 6)], b"bna") == b"bananabanana"
    flat, depth = lz.flattened([(4, 0, 4), (8, 4, 4), (12, 8, 4)])
    assert [f[1] for f in flat] == [0, 0, 0] and depth >= 1


def test_bits():
    w = bits.BitWriter()
    for v in (0, 1, 2, 7, 8, 300):
        w.gamma(v), w.delta(v), w.ternary(v), w.compressed(v)
    r = bits.BitReader(w.done())
    for v in (0, 1, 2, 7, 8, 300):
        assert (r.gamma(), r.delta(), r.ternary(), r.compressed()) == (v,) * 4
    assert r.eof()
    for n in range(40):
        w = bits.BitWriter()
        w.text("1" * n)
        assert len(w.done()) == (n + 2) // 8 + 1 and bits.BitReader(w.done()).bits == "1" * n
    for v in (0, 127, 128, 1 << 40):
        assert bits.read_vbyte(bits.vbyte(v), 0) == (v, len(bits.vbyte(v)))


@pytest.mark.parametrize("name", list(coders.CODERS))
def test_coder_battery(name):
    fib = [1, 2]
    while len(fib) < 60:
        fib.append(fib[-1] + fib[-2])
    text = generators.fibonacci(12)
    c = coders.CODERS[name]()
    e = c.encoder(text)
    for v in fib:
        e.num(v, 0, fib[-1]), e.num(v, v, fib[-1]), e.mind(v, 1, fib[-1])
    for x in generators.thue_morse(8):
        e.bit(x & 1)
    e.lits(text)
    d = c.decoder(e.done())
    for v in fib:
        assert (d.num(0, fib[-1]), d.num(v, fib[-1]), d.mind(1, fib[-1])) == (v, v, v)
    assert [d.bit() for _ in range(128)] == [x & 1 for x in generators.thue_morse(8)]
    assert d.lits(len(text)) == text and d.eof()
    assert c.decoder(c.encoder(b"").done()) is not None


@pytest.mark.parametrize("name", list(grammar.ARRAYS))
def test_number_arrays(name):
    put, get = grammar.ARRAYS[name]
    for v in ([], [0], [5, 5, 5], [3, 1, 2, 9, 0, 1 << 20], list(range(300, 0, -1))):
        assert get(put(v)) == v
    for strategy in ("optimal", "greedy"):
        v = [2, 3, 2, 8, 0, 5, 1, 3]
        assert sorted(i for _, p in grammar.monotone_layers(v, strategy) for i in p) == list(range(8))


def test_grammar_shapes():
    start, rules = grammar.repair_grammar(b"abababab")
    assert grammar.expand(start, rules) == b"abababab" and rules[0] == (97, 98)
    root, rules = grammar.esp_grammar(b"a" * 64)
    assert len(rules) == 6 and grammar.expand([root], rules) == b"a" * 64
    rules, found = grammar.longest_first(b"abcdefXabcdef\0", 2)
    assert rules[0][1] == 6 and len(found) == 2
    assert grammar.depths([(97, 98), (256, 256)]) == [1, 2]


def test_pairs_left_over_in_runs_of_one_symbol():
    # "ac" goes first (ties by pair); of the run of five the head is gone then, and "cc" is there twice.
    assert grammar.repair_grammar(b"acccccac") == ([256, 257, 257, 256], [(97, 99), (99, 99)])
    for s in FIXED + WORDS + drawn():
        start, _ = grammar.repair_grammar(s)
        last, n = {}, {}
        for at, p in enumerate(zip(start, start[1:])):
            if at > last.get(p, -2) + 1:
                n[p], last[p] = n.get(p, 0) + 1, at
        assert max(n.values(), default=0) < 2, s


def test_local_heaps_of_lcpcomp():
    # Longest common prefixes with the suffix before: 2 3 2 4 3 2 5 4 3 2 1 1 0 1 0 0 0, so 0, 1, 3 and 6 wait (2, 3, 4, 5).
    # 6 goes first and shortens 3 to 3; 1 (leftmost of length 3) takes 3 away, whose rest emerges at 4; 0 is too short by then.
    text = b"acaccbccbcccbcac\0"
    assert lz.lcpcomp_factors(text, 2, "plcp", flatten=False) == [(1, 13, 3), (4, 11, 2), (6, 3, 5)]
    assert lz.lcpcomp_factors(text, 2, "plcppeaks", flatten=False) == [(1, 13, 3), (4, 11, 3), (7, 4, 4)]
    for s in FIXED + WORDS + drawn():
        data = transforms.escape(s)
        found = lz.lcpcomp_factors(data, 2, "plcp", flatten=False)
        assert all(p + n <= q for (p, _, n), (q, _, _) in zip(found, found[1:]))
        assert all(n >= 2 and data[p : p + n] == data[r : r + n] for p, r, n in found)
