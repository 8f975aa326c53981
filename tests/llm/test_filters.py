"""Quality rules, language identification, quality classifier."""

import random
import zlib
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pyarrow as pa
import pytest
from fixtures import messy, nothing
from pyspark.sql import functions as F
from support import SF, compare_with_sql

from corpuspress.llm import common, language_id, quality_classifier, quality_rules, suffix


def counts(text):
    words = (text or "").encode().split()
    n = len(words)

    def cover(m):
        seen = Counter(tuple(words[i : i + m]) for i in range(n - m + 1))
        return len({j for i in range(n - m + 1) if seen[tuple(words[i : i + m])] > 1 for j in range(i, i + m)})

    longest = next((m for m in range(n - 1, 0, -1) if len({tuple(words[i : i + m]) for i in range(n - m + 1)}) < n - m + 1), 0)
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    base = n < 50 or 100 * cover(3) > 50 * n
    kept = not base and 100 * cover(8) <= 30 * n and longest <= 32
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, cover(3), cover(8), longest, base, kept


def test_quality_rules(spark):
    df = messy(spark).where("text is null or length(text) < 9000")
    got = Counter(tuple(r) for r in quality_rules.quality_rules(df).collect())
    assert got == Counter((r["doc_id"], *counts(r["text"])) for r in df.collect())
    assert quality_rules.quality_rules(nothing(spark)).count() == 0


def test_quality_rules_sql(spark):
    compare_with_sql(spark, quality_rules.op1_quality_rules, quality_rules.OP1_SQL)


def test_union_of_interval_spans():
    rng = random.Random(3)
    for _ in range(60):
        docs = [[rng.randrange(3) for _ in range(rng.randrange(16))] for _ in range(3)]
        symbols = np.array([3 * i + x for i, d in enumerate(docs) for x in d], np.int64)
        doc = np.array([i for i, d in enumerate(docs) for _ in d], np.int64)
        end = np.cumsum([len(d) for d in docs])[doc] if len(doc) else doc
        if not len(doc):
            continue
        sa, levels = suffix.sort_suffixes(symbols, doc)
        lcp = suffix.neighbour_lcp(sa, levels, end)
        before = np.where(np.append(True, doc[1:] != doc[:-1]), -1 - np.arange(len(doc)), np.append(0, symbols[:-1]))
        for intervals in (suffix.lcp_intervals(lcp, 2), suffix.maximal_repeats(sa, lcp, before, 2)):
            union = np.zeros(len(doc), bool)
            for a, b, d in zip(*intervals):
                for p in sa[a : b + 1]:
                    union[p : p + d] = True
            assert (union == suffix.covered(sa, lcp, 2)).all()


def slow_bits(text, tables):
    """PPM with escapes, straight from the definition."""
    data = b"\n\n\n" + language_id.folded(np.frombuffer(text, np.uint8)).tobytes()
    total = 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            seen = tables[k].get(data[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                total += log2((n + d) / seen[data[i]])
                break
            total += log2((n + d) / d)
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    train = {"x": [b"banana bandana", b"Ananas \xc3\x89t\xc3\xa9"], "y": [b"zebra zoo", b""]}
    codes, numbers, tables = [], [], {}
    for lang, texts in train.items():
        found: Counter = Counter()
        tables[lang] = [defaultdict(Counter) for _ in range(4)]
        for t in texts:
            a = np.frombuffer(t, np.uint8)
            found.update(language_id.fours(a, np.array([0, len(a)])).tolist())
            data = b"\n\n\n" + language_id.folded(a).tobytes()
            for i in range(3, len(data)):
                for k in range(4):
                    tables[lang][k][data[i - k : i]][data[i]] += 1
        codes.append(np.array(sorted(found), np.uint32))
        numbers.append(np.array([found[c] for c in sorted(found)]))
    trees = language_id.Trees(list(train), [language_id.tree_of(*x) for x in zip(codes, numbers)])
    texts = [b"banana", b"", b"zoo\xff\x00q", b"an \xc3\xa9", b"zebra banana" * 5]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = trees.bits(data, offsets)
    want = [[slow_bits(t, tables[lang]) for lang in train] for t in texts]
    assert np.allclose(got, want, rtol=1e-6)


def test_predictions_by_brute_force(spark):
    """Code lengths by the definition, over the trained statistics of whole texts."""
    docs = common.read(spark, SF, "documents")
    rows = docs.collect()
    tables = {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 or r["text"] is None or r["lang"] is None:
            continue
        own = tables.setdefault(r["lang"], [defaultdict(Counter) for _ in range(4)])
        data = b"\n\n\n" + language_id.folded(np.frombuffer(r["text"].encode(), np.uint8)).tobytes()
        for i in range(3, len(data)):
            for k in range(4):
                own[k][data[i - k : i]][data[i]] += 1
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.op4_language_id(spark, SF).collect()}
    for r in rows:
        text = (r["text"] or "").encode()
        if len(text) > 3000:
            continue
        if not any(c.isalpha() for c in text.decode()):
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        bits = {lang: slow_bits(text, tables[lang]) for lang in sorted(tables)}
        least = min(bits.values())
        near = [lang for lang, b in bits.items() if b - least < 1e-2]
        assert got[r["doc_id"]][0] in near
        if len(near) == 1:
            assert abs(got[r["doc_id"]][1] - 1 / sum(2 ** max(least - b, -1000) for b in bits.values())) < 1e-2


def test_rare_strings_beyond_the_bound(spark):
    """Past the bound on nodes all counts stay true, no language is lost, and a string without a node is coded as one never seen there."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "q" + chr(97 + k // 26) + chr(97 + k % 26)]) for _ in range(40)), f"l{k:02}") for i, k in enumerate(list(range(80)) * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole, part = language_id.train(df), language_id.train(df, max_nodes=300)
    assert whole.langs == part.langs == sorted({r[2] for r in rows}) and len(whole.langs) == 80
    assert 0 < sum(len(t.tables[0][0]) for t in part.trees) <= 300 < sum(len(t.tables[0][0]) for t in whole.trees)
    for a, b in zip(whole.trees, part.trees):
        kept, there = language_id.lookup(a.tables[0][0], b.tables[0][0])
        assert there.all() and np.array_equal(a.tables[0][1][kept], b.tables[0][1])
        assert np.array_equal(a.bits1, b.bits1)
    assert all(r["lang_pred"] in whole.langs for r in language_id.predict(df, part).collect())


def test_language(spark):
    df = messy(spark)
    trees = language_id.train(df)
    assert trees.langs == ["de", "en"]
    rows = language_id.predict(df, trees).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["doc_id"] for r in df.collect() if not any(c.isalpha() for c in r["text"] or "")}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in blank) for r in rows if r["doc_id"] not in (9, None))
    nobody = language_id.train(nothing(spark))
    assert {r["lang_pred"] for r in language_id.predict(df, nobody).collect()} == {"und"}
    assert language_id.predict(nothing(spark), trees).count() == 0


def test_language_held_out(spark):
    docs = common.read(spark, SF, "documents")
    rows = language_id.op4_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_trees_and_traversal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    model = quality_classifier.fit(x[:500], y[:500])
    p = model.score(x)
    assert ((p[500:] > 0.5) == y[500:]).mean() > 0.93
    bins = model.binned(x)
    for i in (0, 17, 599):
        total = model.base
        for t in range(len(model.leaf)):
            node = 0
            while node < 15:
                node = 2 * node + 1 + int(bins[i, model.feature[t, node]] > model.cut[t, node])
            total += model.leaf[t, node - 15]
        assert abs(1 / (1 + np.exp(-total)) - p[i]) < 1e-12
    one = quality_classifier.fit(x[:10], np.ones(10))
    assert (one.score(x) > 0.9).all()
    assert np.allclose(quality_classifier.fit(np.zeros((0, 4)), np.zeros(0)).score(x), 0.5)


def test_classifier(spark):
    df = messy(spark)
    labels = spark.createDataFrame([(0, 0, 0), (18, 1, 0), (21, 1, None), (33, None, 0), (None, 1, 1), (18, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_classifier.train(df, labels)
    rows = quality_classifier.score(df, model, ["doc_id", "score"], out="__score").collect()
    assert len(rows) == df.count() and all(0 <= r["__score"] <= 1 for r in rows)
    empty = quality_classifier.train(df, labels.limit(0))
    assert {r["s"] for r in quality_classifier.score(df, empty, ["doc_id"], out="s").collect()} == {0.5}
    assert quality_classifier.score(nothing(spark), model, ["doc_id"]).count() == 0
    assert quality_classifier.statistics(pa.array([None, "", "a"], pa.string())).shape == (3, len(quality_classifier.FEATURES))


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = common.read(spark, sf, "labels")
    rows = quality_classifier.op7_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == 1 for r in rows if r["quality"] == 1]) > 0.97


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_language_id", "op7_quality_classifier"])
def test_queries_cover_every_document(spark, name):
    from corpuspress.llm.queries import QUERIES

    assert QUERIES[name](spark, SF).select(F.countDistinct("doc_id")).first()[0] == 200
