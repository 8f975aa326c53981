"""Texts of over a megabyte, and input columns called like the operators' own."""

import random

import pytest
from fixtures import PASSAGE
from pyspark.sql import functions as F

from corpuspress.llm import fingerprints, language_id, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, token_counts


@pytest.fixture(scope="module")
def long_texts(spark):
    rng = random.Random(1)
    words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(170_000))
    rows = [(1, "word " * 260_000, "en", "s"), (2, words, "en", "s"), (3, words[:600_000] + " " + PASSAGE, "de", "s"), (4, PASSAGE, "de", "t"), (5, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_filters_read_them_whole(long_texts):
    got = by_id(quality_rules.quality_rules(long_texts))
    assert (got[1]["n_words"], got[1]["n_repeat_words"], got[1]["longest_repeat"]) == (260_000, 260_000, 259_999) and got[2]["n_words"] == 170_000
    trees = language_id.train(long_texts)
    assert by_id(language_id.predict(long_texts, trees))[1]["lang_pred"] == "en"
    scored = quality_classifier.score(long_texts, quality_classifier.train(long_texts, long_texts.select("doc_id", (F.col("doc_id") % 2).alias("quality"))), ["doc_id"])
    assert scored.count() == 5


def test_repeats_of_them_are_cut_whole(long_texts):
    got = by_id(substring_dedup.remove_repeats(long_texts))
    assert got[1]["n_removed"] == got[1]["n_bytes"] == 1_300_000 and got[1]["n_spans"] == 1
    # The copy is a prefix of 600,000 bytes with a space after it, which may go on in the original.
    assert 600_000 <= got[2]["n_removed"] <= 600_001 and got[2]["n_spans"] == 1
    assert 600_000 + len(PASSAGE) <= got[3]["n_removed"] <= 600_002 + len(PASSAGE)
    assert got[4]["n_removed"] == len(PASSAGE) and got[5]["n_bytes"] == 0


def test_sets_and_sketches_of_them(long_texts):
    got = by_id(near_dedup.near_duplicates(long_texts))
    assert got[1]["n_shingles"] == 1 and got[2]["n_shingles"] > 169_000 and all(r["kept"] for r in got.values())
    got = by_id(fingerprints.with_successor(long_texts))
    assert got[2]["n_chars"] > 1_000_000 and abs(got[2]["n_shingles"] / 169_998 - 1) < 0.3


def test_tokens_of_them(long_texts):
    rows = packing.best_fit_packing(long_texts, packing.default_tokenizer()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("last")).collect()
    assert {r["doc_id"]: r["n"] for r in rows}[5] == 1 and min(r["last"] for r in rows if r["doc_id"] < 4) > 100
    counts = by_id(token_counts.count_edited(long_texts.withColumn("edits", token_counts.three_edits()), token_counts.default_tokenizer()))
    assert counts[1]["n_tokens"] >= 260_000 and counts[1]["n_reencoded"] < 1000


def test_names_that_clash(spark):
    """Whatever the input's columns are called, they come back as they were."""
    names = ["score", "text", "key", "key2", "row", "spans", "id", "k", "n", "mix", "fit", "fitted", "salt", "__text", "__key", "__score", "__tokens", "__spans", "__u", "part", "Key"]
    names = ["doc_id", *dict.fromkeys(names[:-1])]
    rows = [tuple([i, *[PASSAGE if c == "text" else f"{c}{i}" for c in names[1:]]]) for i in range(3)] + [tuple([9, *["other words than those" if c == "text" else "x" for c in names[1:]]])]
    df = spark.createDataFrame(rows, "doc_id bigint, " + ", ".join(f"`{c}` string" for c in names[1:])).withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    want = {tuple(r) for r in df.collect()}
    labels = spark.createDataFrame([(0, 1), (9, 0)], "doc_id bigint, quality int")
    out = "score_out"
    scored = quality_classifier.score(df, quality_classifier.train(df, labels), df.columns, out=out).drop(out)
    assert scored.columns == df.columns and {tuple(r) for r in scored.collect()} == want
    kept = near_dedup.without_near_duplicates(df)
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} == {r for r in want if r[0] in (0, 9)}
    cut = substring_dedup.cut_repeats(df)
    assert cut.columns == df.columns and {tuple(r) for r in cut.collect()} == {r for r in want if r[0] == 9}
    taken = mixing.sample(df, fraction=1.0)
    assert taken.columns == df.columns and {tuple(r) for r in taken.collect()} <= want
