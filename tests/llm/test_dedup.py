"""Fingerprints, near-duplicates, repeated passages."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import PASSAGE, messy, nothing
from pyspark.sql import functions as F
from support import SF, compare_with_sql

from corpuspress.llm import common, fingerprints, hyperminhash, near_dedup, substring_dedup


def shingles(text, width=3, fold=False):
    data = (text or "").encode()
    words = (data.lower() if fold else data).split()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1)))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches():
    rng = random.Random(2)
    import pyarrow as pa

    sets = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(n)) for n in (0, 1, 2, 3, 40, 3000, 3000)]
    prints = fingerprints.to_strings(*fingerprints.sketches(pa.array(sets)))
    assert prints[0] == "" and len(set(prints)) == 7
    assert fingerprints.distinct_count(prints[4]) == len(shingles(sets[4]))
    assert abs(fingerprints.distinct_count(prints[5]) / len(shingles(sets[5])) - 1) < 0.5
    assert fingerprints.resemblance("", "") == 1 and fingerprints.resemblance("", prints[3]) == 0
    both = fingerprints.merge(prints[5], prints[6])
    assert abs(fingerprints.resemblance(both, prints[5]) - jaccard(shingles(sets[5]) | shingles(sets[6]), shingles(sets[5]))) < 0.25
    assert fingerprints.containment(prints[5], both) > 0.8
    assert fingerprints.merge(prints[4], prints[4]) == prints[4]


@pytest.mark.parametrize("rows_a_range", [1, 3, 2500])
def test_successors(spark, rows_a_range, monkeypatch):
    own = fingerprints.in_order
    monkeypatch.setattr(fingerprints, "in_order", lambda d: own(d, rows_a_range))
    df = messy(spark)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = Counter()
    for i, (k, t) in enumerate(rows):
        after, h = rows[(i + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        want[k, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(shingles(t), shingles(edited)) if len(t) < 600 else None, jaccard(shingles(t), shingles(after)) if max(len(t), len(after)) < 600 else None] += 1
    got = fingerprints.with_successor(df).collect()
    small = lambda r: r["n_chars"] < 600
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter({k[:3]: 0 for k in want}) + Counter(k[:3] for k in want.elements())
    exact = {k[:3]: k[3] for k in want if k[3] is not None}
    for r in got:
        w = exact.get((r["doc_id"], r["n_chars"], r["edited_sha256"]))
        if small(r) and w is not None and len(r["fingerprint"]) < 512 and len(r["edited_fingerprint"]) < 512:
            assert abs(r["near_edited"] - w) < 1e-9
    nexts = Counter((k[0], k[1], k[2], round(k[4], 9)) for k in want.elements() if k[4] is not None)
    got_next = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_next"], 9)) for r in got)
    assert not nexts - got_next and sum(nexts.values()) > 10
    exact = {(k, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + rows[(i + 1) % len(rows)][1][: len(t) // 2]).encode()).hexdigest()): (shingles(t), shingles(t[: len(t) - len(t) // 2] + rows[(i + 1) % len(rows)][1][: len(t) // 2])) for i, (k, t) in enumerate(rows)}
    for r in got:
        a, b = exact[r["doc_id"], r["n_chars"], r["edited_sha256"]]
        share = len(a & b) / len(a) if a else 1.0
        if len(a) < fingerprints.K and len(b) < fingerprints.K:
            assert r["n_shingles"] == len(a) and abs(r["kept_in_edited"] - share) < 1e-9
        else:
            assert abs(r["n_shingles"] / len(a) - 1) < 0.4 and abs(r["kept_in_edited"] - share) < 0.3 and abs(r["near_edited"] - jaccard(a, b)) < 0.25
    equal = defaultdict(set)
    for r in fingerprints.fingerprints(df).join(df.select("doc_id", "text"), "doc_id").collect():
        if r["doc_id"] != 9:
            equal[r["text"] or ""].add(r["fingerprint"])
    assert all(len(v) == 1 for v in equal.values())


def test_successor_edges(spark):
    assert fingerprints.with_successor(nothing(spark)).count() == 0
    one = fingerprints.with_successor(messy(spark).where("doc_id = 30")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def components(rows):
    sets = [shingles(t, 2, True) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return Counter((k, len(sets[i]), low.get(find(i)), low.get(find(i)) == k) for i, (k, _) in enumerate(rows))


def test_near_duplicates(spark):
    df = messy(spark)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == components([(r["doc_id"], r["text"]) for r in df.collect()])
    assert near_dedup.near_duplicates(nothing(spark)).count() == 0


def test_near_duplicate_chains(spark):
    """Versions that drift: many pairs below the threshold whose components still join."""
    rng = random.Random(4)
    rows, words = [], [f"w{i}" for i in range(140)]
    for i in range(120):
        rows.append((1000 - i, " ".join(words)))
        words[rng.randrange(140)] = f"v{i}"
        if i % 4 == 0:
            words[rng.randrange(140)] = f"u{i}"
        if i % 30 == 29:
            words = [f"x{i}_{k}" for k in range(140)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == components(rows)


def test_near_duplicates_sql(spark):
    compare_with_sql(spark, near_dedup.op9_minhash_near_dedup, near_dedup.OP9_SQL)


def test_rows_that_share_an_id(spark):
    """Ids never name a set: a unique text beside a copy of another row under its id is a component of its own."""
    rng = random.Random(9)
    a = " ".join(f"w{rng.randrange(500)}" for _ in range(80))
    near = a.replace(a.split()[40], "changed", 1)
    rows = [(5, a), (3, near), (5, "an unrelated text about something else"), (None, a), (None, "only here and without an id"), (None, "only here and without an id"), (7, "a b c"), (7, "A b c"), (1, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == components(rows)
    assert got[5, 5, 5, True] == 1
    kept = Counter((r["doc_id"], r["text"]) for r in near_dedup.without_near_duplicates(df).collect())
    assert sum(kept.values()) == 6
    assert kept[3, near] == 1 and kept[5, rows[2][1]] == 1 and kept[None, rows[4][1]] == 1 and kept[7, "a b c"] + kept[7, "A b c"] == 1 and kept[1, None] == 1 and kept[1, ""] == 1


def test_rows_of_one_component_and_id(spark):
    """Of rows that differ in other columns only, the same one stays whatever the order."""
    rows = [(1, "some words that are here twice", x) for x in ("p", "q", "r")] + [(2, "some words that are here twice", "s")]
    stay = {near_dedup.without_near_duplicates(spark.createDataFrame(r, "doc_id bigint, text string, key2 string")).first() for r in (rows, rows[::-1])}
    assert len(stay) == 1 and next(iter(stay))["doc_id"] == 1


def test_members_of_a_hot_bucket(spark):
    """A template shared by many texts that are all below the threshold, and some pairs above it."""
    rng = random.Random(6)
    head = [f"h{i}" for i in range(100)]
    own = lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(i, " ".join(head + own(30))) for i in range(150)]
    tails = [own(30) for _ in range(6)]
    rows += [(1000 + 10 * i + j, " ".join(head + t[:-1] + own(1))) for i, t in enumerate(tails) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == components(rows)
    rows = near_dedup.nodes_of(near_dedup.signed(df, "doc_id", "text"))
    texts = rows.join(df.withColumnRenamed("doc_id", "rep"), "rep").select("node", "n", F.col("node").alias("comp"), "text")
    assert near_dedup.prefix_pairs(near_dedup.prefix_rows(texts, 80), 80, 2).count() < 40


def test_versions_of_one_text(spark, monkeypatch):
    """Versions on both sides of the threshold: what is fetched to be confirmed doesn't grow with the square of their number."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(300)], []
    for i in range(240):
        version = list(base)
        for at in rng.sample(range(300), rng.randrange(4, 40)):
            version[at] = word() if rng.random() < 0.5 else base[rng.randrange(300)]
        rows.append((i, " ".join(version)))
    df, fetched, confirmed = spark.createDataFrame(rows, "doc_id bigint, text string"), [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, *how: fetched.append(pairs.count()) or confirmed(pairs, *how))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == components(rows) and len({c for _, _, c, _ in got}) > 20
    assert fetched[1] < len(rows)


def test_rows_that_stay(spark):
    df = messy(spark)
    kept = near_dedup.without_near_duplicates(df)
    assert kept.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    worded = [r for r in rows if (r[1] or "").split()]
    assert len(worded) == len(set(worded)) and (18, df.where("doc_id = 18").first()["text"]) in rows and not any(k in (21, 24) for k, _ in rows)
    empty = Counter((r["doc_id"], r["text"]) for r in df.collect() if not (r["text"] or "").split())
    assert Counter(r for r in rows if not (r[1] or "").split()) == empty


def test_registers():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 2000), np.uint64)
    x, y = np.sort(np.concatenate([a, b[:500]])), np.sort(np.concatenate([a, b[500:1000]]))
    regs = hyperminhash.registers(np.array([0, 2500, 5000, 5000]), np.concatenate([x, y]))
    similarity, cells = hyperminhash.estimate((regs[0][:1], regs[1][:1]), (regs[0][1:2], regs[1][1:2]))
    assert abs(similarity[0] - 2000 / 3000) < 0.15 and cells[0] == 128
    assert (regs[0][2] == 0).all() and (regs[0][:2] > 0).all()
    few, chosen = hyperminhash.registers(np.array([0, 3]), np.sort(a[:3]))
    assert len(np.unique(few)) == 3 and chosen.sum() == 3


def test_estimates_of_all_sizes():
    """The bound follows the registers that are filled: pairs at the threshold pass at every size, far ones don't where there are enough."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 9, 20, 45, 90, 300, 900):
        both = -(-8 * n // 9)
        sets, far = [], []
        for _ in range(60):
            h = rng.integers(0, 1 << 63, 4 * n + 2, np.uint64)
            sets += [np.sort(h[:n]), np.sort(np.concatenate([h[:both], h[n : 2 * n - both]]))]
            far += [np.sort(h[2 * n : 3 * n])]
        pack = lambda x: hyperminhash.unpacked(hyperminhash.packed(np.cumsum([0, *map(len, x)]), np.concatenate(x)))
        a, b, c = pack(sets[::2]), pack(sets[1::2]), pack(far)
        assert not hyperminhash.surely_below(*hyperminhash.estimate(a, b), 0.8).any()
        if n >= 45:
            assert hyperminhash.surely_below(*hyperminhash.estimate(a, c), 0.8).all()


def brute(rows, length):
    where = defaultdict(int)
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - length + 1):
            where[t[i : i + length]] += 1
    out = Counter()
    for (k, _), t in zip(rows, texts):
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if where[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, mark) if not m)
        runs = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        out[k, len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("most", [10_000, 1])
def test_repeated_passages(spark, most):
    df = messy(spark)
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(df, most_contexts=most).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()], 200)
    assert substring_dedup.remove_repeats(nothing(spark)).count() == 0


@pytest.mark.parametrize("most", [10_000, 2])
def test_ends_of_repeats(spark, most):
    """Overlapping, nested and periodic repeats with all kinds of ends."""
    rng = random.Random(8)
    base = [bytes(rng.choice(b"abcd") for _ in range(500)).decode() for _ in range(3)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rng.randrange(1, 4)):
            b = rng.choice(base)
            s = rng.randrange(0, 320)
            t += "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 30))) + b[s : s + rng.randrange(150, 420)]
        rows.append((i, t))
    rows += [(100, "ab" * 300), (101, "abc" * 70), (102, "q" * 201), (103, "abc" * 67 + "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(df, most_contexts=most).collect())
    assert got == brute(rows, 200)


@pytest.mark.parametrize("most", [10_000, 2])
def test_maximal_repeats(spark, most):
    """Each repeat has all places of its string, can't be extended, and together they are the bytes that go."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd") for _ in range(500)) for _ in range(2)]
    rows = []
    for i in range(24):
        s = rng.randrange(0, 200)
        rows.append((i, "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 30))) + rng.choice(base)[s : s + rng.randrange(150, 420)] + rng.choice("xyz")))
    texts = {k: t.encode() for k, t in rows}
    groups = defaultdict(set)
    for r in substring_dedup.maximal_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), most_contexts=most).collect():
        assert (r["doc_id"], r["lo"], r["hi"]) not in groups[r["repeat"]]
        groups[r["repeat"]].add((r["doc_id"], r["lo"], r["hi"]))
    marks = {k: bytearray(len(t)) for k, t in texts.items()}
    for places in groups.values():
        strings = {texts[k][a:b] for k, a, b in places}
        assert len(strings) == 1 and len(places) > 1
        one = next(iter(strings))
        assert len(one) >= 200
        assert {(k, a) for k, a, _ in places} == {(k, i) for k, t in texts.items() for i in range(len(t)) if t.startswith(one, i)}
        if len(one) < 350 and most > 2:
            assert len({texts[k][a - 1 : a] or k for k, a, _ in places}) > 1 or max(b - a for _, a, b in places) >= 200
        for k, a, b in places:
            marks[k][a:b] = b"\1" * (b - a)
    got = Counter((k, sum(m)) for k, m in marks.items())
    assert got == Counter((k[0], k[2]) for k in brute(rows, 200).elements())


def test_groups_are_maximal():
    """Against all pairs of contexts: what two of them share around the anchor, as far as possible, is a repeat, and there is no other."""
    rng = random.Random(5)
    core = bytes(rng.choice(b"ab") for _ in range(150))
    texts, left = [], []
    for _ in range(14):
        n = rng.randrange(0, 20)
        a, b = rng.randrange(30, 60), rng.randrange(10, 40)
        text = bytes(rng.choice(b"cd") for _ in range(n)) + core[a : len(core) - b] + bytes(rng.choice(b"cd") for _ in range(rng.randrange(0, 20)))
        anchor = n + 60 - a
        left.append(min(anchor, 30))
        texts.append(text[anchor - left[-1] : anchor + 80])
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    length = 80

    def shared(rows):
        before = min(left[i] for i in rows)
        after = min(len(texts[i]) - left[i] for i in rows)
        x = next((k for k in range(before) if len({texts[i][left[i] - 1 - k] for i in rows}) > 1), before)
        y = next((k for k in range(min(after, length)) if len({texts[i][left[i] + k] for i in rows}) > 1), min(after, length))
        return min(x, length - 50), y

    want = set()
    for i in range(len(texts)):
        for j in range(i):
            x, y = shared([i, j])
            if x + y >= length:
                rows = [k for k in range(len(texts)) if all(u >= v for u, v in zip(shared([i, k]), (x, y)))]
                want.add((frozenset(rows), *shared(rows)))
    got = substring_dedup.repeat_groups(data, offsets, np.array(left), np.zeros(len(texts), np.int64), length)
    number, rows = got.members()
    sets = defaultdict(set)
    for g, r in zip(number.tolist(), rows.tolist()):
        sets[g].add(r)
    found = [(frozenset(sets[g]), int(got.before[g]), int(got.after[g])) for g in sets]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 5
    far, near = got.spans(len(texts))
    for i in range(len(texts)):
        mine = [(x, y) for rows, x, y in want if i in rows]
        assert (far[i], near[i]) == ((max(x for x, _ in mine), max(y for _, y in mine)) if mine else (-1, -1))


def test_windows_of_a_long_text():
    """Anchors and contexts of a text don't depend on the windows it is read in."""
    import pyarrow as pa

    rng = random.Random(3)
    text = "".join(rng.choice("ab ") for _ in range(9000)) + "ab" * 2000 + "é" * 500
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([2], pa.int64()), pa.array([text])], ["key", "doc_id", "text"])

    def all_of(window):
        found = list(substring_dedup.anchored(iter([batch]), 200, window))
        assert window > 10**6 or len(found) > 10
        return [(int(p), int(g), int(c), int(f.base + a), int(f.base + b)) for f in found for p, g, c, a, b in zip(f.pos, f.gram, f.contexts(), f.low, f.high)]

    assert all_of(777) == all_of(1 << 20)


def test_cut_texts(spark):
    df = messy(spark)
    cut = substring_dedup.cut_repeats(df)
    assert cut.columns == df.columns and [f.dataType for f in cut.schema] == [f.dataType for f in df.schema]
    rows = cut.collect()
    assert not any(PASSAGE[20:-20] in (r["text"] or "") for r in rows)
    kept = {r["doc_id"]: r for r in rows}
    assert kept[36]["text"] == df.where("doc_id = 36").first()["text"] and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] and r["doc_id"] in (27, 30, 33))
    assert 18 not in kept and None in {r["text"] for r in rows}


def test_one_python_worker_a_task(spark, monkeypatch):
    """No task of op8, op9 and the pipeline's stages feeds one Python worker from another: each holds memory of its executor."""
    plans, written = [], common.written
    see = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(common, "written", lambda df, name: written(see(df), name))
    df, least = messy(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        for out in (substring_dedup.remove_repeats(df, most_contexts=1), substring_dedup.cut_repeats(df), near_dedup.without_near_duplicates(df)):
            see(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    for plan in plans:
        above: list[tuple[int, bool]] = []
        for line in plan.splitlines():
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [(d, python) for d, python in above if d < depth]
            if "Exchange" in line:
                above = []
            python = "MapInArrow" in line or "ArrowEvalPython" in line
            assert not (python and any(p for _, p in above)), plan
            above.append((depth, python))
    assert any("ArrowEvalPython" in p for p in plans) and any("MapInArrow" in p for p in plans)


def test_repeats_sql(spark):
    compare_with_sql(spark, substring_dedup.op8_suffix_array_dedup, substring_dedup.OP8_SQL)


def test_queries_cover_every_document(spark):
    from corpuspress.llm.queries import QUERIES

    for name in ("op5_bottom_k_fingerprints", "op8_suffix_array_dedup", "op9_minhash_near_dedup"):
        assert QUERIES[name](spark, SF).select(F.countDistinct("doc_id")).first()[0] == common.read(spark, SF, "documents").count()


@pytest.mark.parametrize("most", [10_000, 2])
def test_sizes_of_repeats(spark, most):
    """They are those of the occurrences, also where contexts have many copies and ids are shared or missing."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abcd") for _ in range(500)) for _ in range(2)]
    rows = []
    for i in range(20):
        s = rng.randrange(0, 200)
        t = "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 30))) + rng.choice(base)[s : s + rng.randrange(150, 420)] + rng.choice("xyz")
        rows += [(None if i == 3 else i % 15, t + "q" * (k % 2)) for k in range(1 + 12 * (i % 3 == 0))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    by = defaultdict(list)
    for r in substring_dedup.maximal_repeats(df, most_contexts=most).collect():
        by[r["repeat"]].append((r["doc_id"] is not None, r["doc_id"] or 0, r["lo"], r["hi"] - r["lo"]))
    want = Counter((max(p[3] for p in v), len(v), *(min(v)[1:3] if min(v)[0] else (None, min(v)[2]))) for v in by.values())
    got = Counter((r["n_bytes"], r["n_occurrences"], *r["first"]) for r in substring_dedup.repeat_sizes(df, most_contexts=most).collect())
    assert got == want and len(want) > 1
