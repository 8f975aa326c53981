"""Archives, mixing, token counts, packing, pipeline."""

import os
import random
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import messy, nothing, texts
from pyspark.sql import functions as F
from support import SF, compare_with_sql

from corpuspress.llm import common, mixing, packing, token_counts, warc

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def pages(spark):
    inner = warc.record("77", "http://x/", b"<p>stolen</p>", None).decode()
    html = ["<p>a</p>", None, "", inner, "x\r\n\r\n" + inner + inner, "<p>a</p>", "WARC/1.1\r\n", "é" * 5000, inner, "<p>a</p>", "long " * 20000]
    rows = [(i if i != 4 else None, "http://site/ü ?\r\n" if i % 2 else None, h, i) for i, h in enumerate(html)] + [(0, "again", "<p>a</p>", 5), (None, None, "<p>a</p>", 6)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int")


@pytest.mark.parametrize("gzip", [True, False])
@pytest.mark.parametrize("cut", [100, 3000, 16 << 20])
def test_archives(spark, gzip, cut):
    df = pages(spark).repartition(3)
    files = warc.write_warc(df, common.shared_dir(spark, "warc"), gzip=gzip, file_bytes=60_000)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, files, cut).collect())
    first: dict[str, int] = {}
    for r in df.collect():
        if r["page_id"] is not None:
            first[r["html"] or ""] = min(first.get(r["html"] or "", r["page_id"]), r["page_id"])
    want = Counter()
    for r in df.collect():
        data, f = (r["html"] or "").encode(), first.get(r["html"] or "")
        response = f is None or r["page_id"] == f
        want[None if r["page_id"] is None else str(r["page_id"]), len(data), warc.digest(data), "response" if response else "revisit", None if response else str(f)] += 1
    assert got == want


@pytest.mark.parametrize("gzip", [True, False])
def test_headers_of_any_length(spark, gzip):
    """A header of over 64 KiB is a record, and so is all that follows it."""
    rows = [(1, "http://a/", "<p>a</p>"), (2, "http://b/" + "é" * 30_000, "<p>b</p>"), (3, "http://c/", "<p>c</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    for cut in (1000, 16 << 20):
        files = warc.write_warc(df, common.shared_dir(spark, "warc"), gzip=gzip)
        assert {r["page_id"] for r in warc.read_warc(spark, files, cut).collect()} == {"1", "2", "3"}


def test_the_query_rejects_magic(spark, tmp_path):
    """Records inside payloads look like records to the query's own archives, and none of them comes back."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages(spark).collect()]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    seen = []
    own = warc.reachable_entries
    try:
        warc.reachable_entries = lambda found, *a: (seen.append(found.count()), own(found, *a))[1]
        got = warc.op2_warc_boundary_chain(spark, str(tmp_path)).count()
    finally:
        warc.reachable_entries = own
    assert got == len(rows) and seen[0] == got + 3


def test_no_pages(spark):
    files = warc.write_warc(pages(spark).limit(0), common.shared_dir(spark, "warc"))
    assert warc.read_warc(spark, files).count() == 0


def test_damage_ends_a_chain(spark, tmp_path):
    one, two = (warc.record(str(i), None, b"x" * 50, None) for i in (1, 2))
    (tmp_path / "a.warc").write_bytes(one + b"garbage" + two)
    (tmp_path / "b.warc").write_bytes(one + two[:-30])
    files = spark.createDataFrame([(str(tmp_path / n), os.path.getsize(tmp_path / n)) for n in ("a.warc", "b.warc")], "path string, size bigint")
    assert sorted(r["page_id"] for r in warc.read_warc(spark, files, 64).collect()) == ["1", "1"]


def test_archives_sql(spark):
    compare_with_sql(spark, warc.op2_warc_boundary_chain, warc.OP2_SQL)


def test_mixing(spark):
    df = messy(spark).withColumn("mix", F.lit("mine")).withColumn("fit", F.lit("mine"))
    features, mix = mixing.featured(df)
    rows = mixing.weighted(features, mix).collect()
    assert len(rows) == df.count() and mix == "_mix" and all(r["mix"] == r["fit"] == "mine" for r in rows)
    assert all(0 <= r[mix]["probability"] <= 1 and r[mix]["sampled"] == (r[mix]["u"] < r[mix]["probability"]) for r in rows)
    assert mixing.sample(df).columns == df.columns
    empty, mix = mixing.featured(nothing(spark))
    assert mixing.weighted(empty, mix).count() == 0


def test_topics_of_odd_texts(spark):
    """A run of letters is read once, not from each of its letters; letters that fold to others count as in the SQL."""
    texts = ["a" * 1_000_000, "a" * 300_000 + "@b", "licen\u017fe", "COPYRIGHT", "a |b\n| c", "| c |", "1 23 456", None, ""]
    features, mix = mixing.featured(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string"))
    began = time.time()
    got = {r["doc_id"]: tuple(r[mix])[2:4] for r in features.collect()}
    assert time.time() - began < 30
    assert [got[i] for i in range(len(texts))] == [("general", 1), ("contact", 1), ("legal", 1), ("legal", 1), ("general", 4), ("tabular", 3), ("numeric", 3), ("general", 0), ("general", 0)]


def test_many_cells(spark, monkeypatch):
    """The fit on the driver and the one by aggregations are the same, sweep for sweep."""
    monkeypatch.setattr(mixing, "MOST_SWEEPS", 3)
    monkeypatch.setattr(mixing, "HALVINGS", 5)
    features, mix = mixing.featured(messy(spark))
    cells = [tuple(r) for r in mixing.cells_of(features, mix).collect()]
    capped = [{r[:3]: r[3:] for r in f} for f in (mixing.fit_local(cells, None, 0.5, False, boost=1.1), [tuple(r) for r in mixing.fit_spark(mixing.cells_of(features, mix), None, 0.5, False, boost=1.1).collect()])]
    assert capped[0].keys() == capped[1].keys() and all(np.allclose(capped[0][k], capped[1][k], rtol=1e-7) for k in capped[0])
    local = {r[:3]: r[3:] for r in mixing.fit_local(cells, None, 0.5, bounded=False)}
    few = {tuple(r[mix][d] for d in mixing.DIMS): (r[mix]["weight"], r[mix]["probability"]) for r in mixing.weighted(features, mix, fraction=0.5, bounded=False, most_cells=1).collect()}
    assert few.keys() == local.keys() and all(abs(few[k][0] - w) < 1e-9 and abs(few[k][1] - min(1, w * f)) < 1e-9 for k, (w, f) in local.items())
    rows = [("a", "x", "p", 300.0), ("a", "y", "p", 100.0), ("b", "x", "p", 100.0), ("b", "y", "q", 80.0), ("a", "y", "q", 30.0)]
    wanted = {"source": {"a": 1, "b": 1}, "lang": {"x": 1, "y": 1}, "topic": {"p": 4, "q": 1}}
    local = {r[:3]: r[3:] for r in mixing.fit_local(rows, wanted, 0.3)}
    spread = {tuple(r)[:3]: tuple(r)[3:] for r in mixing.fit_spark(spark.createDataFrame(rows, "source string, lang string, topic string, tokens double"), wanted, 0.3).collect()}
    assert local.keys() == spread.keys() and all(np.allclose(local[k], spread[k], rtol=1e-9) for k in local)


def marginals(got, n, total, value):
    return {(dim, v): sum(n[r[:3]] * value(r) for r in got if r[d] == v) / total for d, dim in enumerate(mixing.DIMS) for v in {r[d] for r in got}}


@pytest.mark.parametrize("fraction", [0.1, 0.4, 0.95])
def test_marginals_are_met(fraction):
    """At any fraction that is asked for the expected sample has the target shares, and is as large as said."""
    rng = random.Random(1)
    cells = [(s, l, t, float(rng.randrange(1, 500))) for s in "abc" for l in "xy" for t in "pq"]
    wanted = {"source": {"a": 1, "b": 1, "c": 2}, "lang": {"x": 3, "y": 1}, "topic": {"p": 1, "q": 1}}
    got = mixing.fit_local(cells, wanted, fraction)
    n = {c[:3]: c[3] for c in cells}
    total, least = sum(n.values()), got[0][4]
    assert all(r[4] == least <= fraction and r[3] * least <= 1 + 1e-12 for r in got)
    have = marginals(got, n, total, lambda r: r[3])
    for dim, shares in wanted.items():
        for v, share in shares.items():
            assert abs(have[dim, v] - share / sum(shares.values())) < 1e-6
    expected = marginals(got, n, total * least, lambda r: min(1.0, r[3] * least))
    assert all(abs(expected[k] - x) < 1e-9 for k, x in have.items())
    # The fullest value allows so much: a value's share of the sample can't be more than all it has.
    room = min(sum(c[3] for c in cells if c[d] == v) / total / (w / sum(wanted[dim].values())) for d, dim in enumerate(mixing.DIMS) for v, w in wanted[dim].items())
    assert least == fraction if fraction < 0.2 else least <= room + 1e-9


def test_boost_bounds_the_targets():
    tokens = {"source": {"a": 1000.0, "b": 10.0, "c": 1.0, "d": 0.0}, "lang": {"x": 5.0}, "topic": {"p": 3.0, "q": 1.0}}
    got = mixing.targets(tokens, boost=1.25)
    for dim, shares in got.items():
        whole = sum(tokens[dim].values())
        assert abs(sum(shares.values()) - 1) < 1e-9 and all(x <= 1.25 * tokens[dim][v] / whole + 1e-12 for v, x in shares.items())


def test_targets_without_tokens():
    """A target that no weight meets: what can be met is, and nothing runs on."""
    got = mixing.fit_local([("a", "x", "p", 100.0), ("b", "x", "p", 0.0), ("b", "y", "p", 50.0)], {"source": {"a": 1, "b": 1}, "lang": {"x": 9, "y": 1}}, 0.5)
    assert len(got) == 3 and all(np.isfinite(r[3]) for r in got)


def test_mixing_sql(spark):
    compare_with_sql(spark, mixing.op3_mixing, mixing.OP3_SQL)


def test_marginals_of_the_query_and_of_repeated_rows(spark):
    sf01 = "/root/testdata/sf0.01"
    rows = mixing.op3_mixing(spark, sf01).collect()
    sums = {d: Counter() for d in mixing.DIMS}
    expected = {d: Counter() for d in mixing.DIMS}
    for r in rows:
        for d in mixing.DIMS:
            sums[d][r[d]] += r["n_tokens"]
            expected[d][r[d]] += r["n_tokens"] * r["probability"]
    aims, total = mixing.targets(sums), sum(r["n_tokens"] for r in rows)
    for d in mixing.DIMS:
        for v, aim in aims[d].items():
            assert abs(expected[d][v] / sum(expected[d].values()) - aim) < 1e-5
    assert abs(sum(expected["lang"].values()) / total - mixing.FRACTION) < 1e-5
    features, mix = mixing.featured(common.read(spark, sf01, "documents").select("doc_id", "text", "source", "lang"))
    report = {(r["dim"], r["value"]): r for r in mixing.shares(mixing.weighted(features, mix), mix).collect()}
    assert all(abs(report[d, v]["expected"] - aim) < 1e-5 and abs(report[d, v]["natural"] - sums[d][v] / total) < 1e-9 for d in mixing.DIMS for v, aim in aims[d].items())
    for fraction in (0.8, 0.9):
        got = mixing.repeated(features, mix, fraction=fraction).collect()
        kept = sum(r[mix]["tokens"] for r in got)
        assert abs(kept / total - fraction) < 0.03
        for d in mixing.DIMS:
            drawn = Counter()
            for r in got:
                drawn[r[mix][d]] += r[mix]["tokens"]
            for v, aim in aims[d].items():
                assert abs(drawn[v] / kept - aim) < 0.025, (fraction, d, v)
        assert max(Counter(r["doc_id"] for r in got).values()) > 1


def test_token_trees():
    c = token_counts.counter(token_counts.default_tokenizer())
    rng = random.Random(3)
    letters = ["a", "b", " ", "  ", "\n", "\t", " x", "'s", "é", "12", "!!", " \n", " ", "don't"]
    for _ in range(300):
        s = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 20, 400])))
        t = token_counts.TokenTree(s, c)
        for _ in range(5):
            at, cut, put = rng.randrange(len(s) + 2), rng.choice([0, 1, 7, len(s)]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5])))
            again = t.edit(at, cut, put)
            s = s[:at] + put + s[at + cut :]
            assert (t.text(), t.tokens[1], t.chars[1]) == (s, len(c.coder.encode_ordinary(s)), len(s)) and again <= len(s)
    long = token_counts.TokenTree("word " * 5000, c)
    assert long.edit(12000, 3, "new") < 50  # only what the edit touches


def test_token_counts(spark):
    c = token_counts.counter(token_counts.default_tokenizer()).coder
    df = messy(spark).withColumn("edits", token_counts.three_edits())
    got = {(r["doc_id"], r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) for r in token_counts.count_edited(df, token_counts.default_tokenizer()).collect()}
    want = set()
    for r in df.collect():
        s = r["text"] or ""
        before = len(c.encode_ordinary(s))
        for e in r["edits"]:
            s = s[: e["at"]] + e["put"] + s[e["at"] + e["cut"] :]
        want.add((r["doc_id"], before, len(c.encode_ordinary(s)), len(s)))
    assert got == want
    odd = spark.createDataFrame([(1, "abc", None), (2, "abc", [(None, 1, "x"), (99, 5, None), (1, 1, None)])], f"doc_id bigint, text string, edits {token_counts.EDITS}")
    assert {r["doc_id"]: r["n_chars_edited"] for r in token_counts.count_edited(odd, token_counts.default_tokenizer()).collect()} == {1: 3, 2: 2}
    assert token_counts.count_edited(nothing(spark).withColumn("edits", token_counts.three_edits()), token_counts.default_tokenizer()).count() == 0


def check_packing(rows, documents, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    ids = [np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for _, t in documents]
    want = Counter()
    for (k, _), x in zip(documents, ids):
        for p, at in enumerate(range(0, len(x), capacity)):
            part = x[at : at + capacity]
            want[k, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), sum(map(len, ids))


def test_packing(spark):
    df = messy(spark)
    rows = packing.best_fit_packing(df, packing.default_tokenizer(), 256).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in df.collect()], 256)
    assert packing.best_fit_packing(nothing(spark), packing.default_tokenizer()).count() == 0
    several = packing.best_fit_packing(df, packing.default_tokenizer(), 64, most_open=2, group_pieces=20).collect()
    check_packing(several, [(r["doc_id"], r["text"]) for r in df.collect()], 64)


def test_packing_is_tight(spark):
    rows = packing.op10_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    docs = common.read(spark, "/root/testdata/sf0.01", "documents").collect()
    n, tokens = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs], 2048)
    assert n <= 1.03 * -(-tokens // 2048)


def test_bounded_space():
    rng = random.Random(6)
    lengths = [rng.randrange(1, 101) for _ in range(3000)]
    for most in (1, 3, 1000):
        bins = packing.OpenBins(100, most)
        free: dict[int, int] = {}
        still: set[int] = set()
        for n in lengths:
            best = min(((free[b], b) for b in still if free[b] >= n), default=None)
            b, o = bins.place(n)
            if best is None:
                assert o == 0 and b not in free
                free[b] = 100
            else:
                assert free[b] == best[0] and o == 100 - free[b]
                still.discard(b)
            free[b] -= n
            if free[b]:
                still.add(b)
                if len(still) > most:
                    still.discard(min(still, key=lambda x: (free[x], x != b)))
                    still = {b for level in bins.bins for b in level}
            assert bins.open == len(still) <= most
        assert sum(map(len, bins.bins)) == bins.open


def test_words_take_either_way():
    w = packing.WordIds(packing.default_tokenizer())
    assert w.short
    rng = random.Random(7)
    for t in [*(t or "" for t in texts()), "don't I'LL we've'", "ÉÑß Σίσυφος ΟΔΟΣ", "<|endoftext|> x<|startoftext|>y", "x\x1cy", "İ ½ Ⅷ ﬁ 日本 a b", *("".join(rng.choice("aB'1é́<|> ßΣ\n.-№") for _ in range(30)) for _ in range(300))]:
        import pyarrow as pa

        assert w.encode(pa.array([t]))[0] == np.array(w.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_pipeline(spark):
    import corpus_pipeline

    SF01 = "/root/testdata/sf0.01"  # enough labels to learn from
    assert len(corpus_pipeline.STAGES) == 5
    docs = common.read(spark, SF01, "documents")
    columns, counts = docs.columns, [docs.count()]
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF01), "stage")
        assert docs.columns == columns, name
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept <= ids and docs.count() == len(kept)
        ids = kept
        counts.append(len(kept))
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] > 0.5 * counts[0]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF01).collect()} == ids


def test_stages_on_messy_rows(spark):
    import corpus_pipeline

    for source in (messy(spark), nothing(spark)):
        docs = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.written(stage(spark, docs, SF), "stage")
            assert docs.columns == source.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0


def test_everything_else_works_without_them(tmp_path):
    subprocess.run(["cp", "-r", os.path.join(ROOT, "corpuspress"), os.path.join(ROOT, "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "corpuspress/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'text_profile' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
