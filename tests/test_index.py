import random

import numpy as np
import pytest

from corpuspress.operators import index
from corpuspress.operators.transforms import escape


def naive(t: bytes):
    n = len(t)
    sa = sorted(range(n), key=lambda i: t[i:])
    lce = lambda a, b: next((k for k in range(n) if a + k >= n or b + k >= n or t[a + k] != t[b + k]), n)
    lcp = [0] + [lce(sa[i - 1], sa[i]) for i in range(1, n)]
    return sa, lcp, lce


@pytest.mark.parametrize("seed", range(40))
def test_invariants(seed):
    rng = random.Random(seed)
    t = escape(bytes(rng.choice(b"abc\0") for _ in range(rng.randrange(30))))
    sa, lcp, lce = naive(t)
    x, n = index.of(t), len(t)
    assert x.sa.tolist() == sa and x.lcp.tolist() == lcp
    isa = [sa.index(i) for i in range(n)]
    assert x.isa.tolist() == isa
    assert x.phi.tolist() == [sa[isa[i] - 1] for i in range(n)]
    assert x.plcp.tolist() == [lcp[isa[i]] for i in range(n)]
    assert x.psi.tolist() == [isa[(sa[i] + 1) % n] for i in range(n)]
    assert x.bwt.tolist() == [t[i - 1] for i in sa]
    assert x.lpf.tolist() == [max([lce(i, j) for j in range(i)], default=0) for i in range(n)]
    assert x.sl.tolist() == [i == n - 1 or t[i:] < t[i + 1 :] for i in range(n)]
    starts, i = set(), 0
    while i < n:  # Duval
        j, k = i + 1, i
        while j < n and t[k] <= t[j]:
            k = i if t[k] < t[j] else k + 1
            j += 1
        while i <= k:
            starts.add(i)
            i += j - k
    assert set(np.flatnonzero(x.lyndon).tolist()) == starts


def test_many_texts_at_once():
    texts = [escape(b) for b in (b"banana", b"", b"bandana", b"banana")]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x = index.Index(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for k, t in enumerate(texts):
        one = index.of(t)
        part = slice(offsets[k], offsets[k + 1])
        for name in ("sa", "isa", "phi", "psi", "lf"):
            assert (getattr(x, name)[part] - offsets[k]).tolist() == getattr(one, name).tolist(), name
        for name in ("lcp", "plcp", "lpf", "bwt", "lyndon", "sl"):
            assert getattr(x, name)[part].tolist() == getattr(one, name).tolist(), name


def test_only_what_is_asked_for():
    assert index.closure(("plcp",)) == ["sa", "lcp", "plcp"]
    with pytest.raises(ValueError):
        index.closure(("nothing",))


def test_characteristics(spark):
    """All columns against the definitions, over texts of all kinds in one batch."""
    from math import log2

    from corpuspress.operators import profile

    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "a"), (3, "ab" * 40), (4, "banana"), *((i, "".join(rng.choice("abc é") for _ in range(rng.randrange(60)))) for i in range(5, 25))]
    got = {r["doc_id"]: r for r in profile.characteristics(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got.keys() == {k for k, t in rows if t is not None}
    for k, text in rows[1:]:
        raw = text.encode()
        t = escape(raw)
        sa, lcp, lce = naive(t)
        z = i = 0
        while i < len(t):
            i += max([1, *(lce(j, i) for j in range(i))])
            z += 1
        bwt = [t[p - 1] for p in sa]
        r = got[k]
        assert (r["sigma"], r["max_lcp"], r["bwt_runs"], r["z"]) == (len(set(raw)), max(lcp), 1 + sum(a != b for a, b in zip(bwt, bwt[1:])), z), text
        assert abs(r["avg_lcp"] - sum(lcp) / len(t)) < 1e-9
        for order in range(4):
            grams = [raw[i : i + order + 1] for i in range(len(raw) - order)]
            bits = sum(log2(sum(h[:-1] == g[:-1] for h in grams) / grams.count(g)) for g in grams)
            assert abs(r[f"h{order}"] - bits / max(1, len(raw))) < 1e-9
