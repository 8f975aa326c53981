"""A training-data pipeline over ``documents``: five stages, each written and reread.

Quality classifier, MinHash near-dedup, suffix-array dedup, mixing sources to
target weights, best-fit packing.  Each stage works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.

In every stage a null text counts as an empty one and stays null; rows that
repeat, or share or lack an id, are documents of their own; very long texts are
processed whole; an empty table gives an empty result; further columns, whatever
their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspress.llm import common, mixing, near_dedup, packing, quality_classifier, substring_dedup
from corpuspress.session import attach

#: A document stays if the classifier's score is at least this, as in op7.
LEAST_SCORE = 0.3
#: Exponents of the natural shares that give the target shares: milder than in op3, so that more can stay.
MIX_TEMPER = {"source": 0.9, "lang": 0.9, "topic": 0.9}
#: No value's target is over so many times its natural share: rare values would decide how little can stay.
MIX_BOOST = 1.25
#: Share of the tokens that the mixing stage tries first; it is lowered until the targets can be met.
MIX_FRACTION = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Empty and null texts are scored like others; without usable labels every
    score is 0.5 and all stay; equal texts have equal scores, so copies stay or
    go together.
    """
    attach(spark)
    model = quality_classifier.train(docs, common.read(spark, sf_dir, "labels"))
    (out,) = common.free(docs.columns, "score")
    return quality_classifier.score(docs, model, docs.columns, out=out).where(F.col(out) >= LEAST_SCORE).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: one with the smallest id.

    Texts without words (null, empty, blank) are copies of nothing and all stay;
    of rows that repeat, or of several with the group's id, one stays, chosen by a
    hash of its content; a group without any id keeps one row.
    """
    attach(spark)
    return near_dedup.without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that are found twice are cut out; emptied documents go.

    Texts that had no words stay as they are; rows that repeat a text of 200 bytes
    lose it; ``n_chars`` is that of the text that is left.
    """
    attach(spark)
    return substring_dedup.cut_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that the expected shares of sources, languages and topics are the target shares.

    Null sources and languages are a value each; texts without tokens are sampled
    like others of their values; rows that share an id are drawn together.
    """
    attach(spark)
    return mixing.sample(docs, fraction=MIX_FRACTION, temper=MIX_TEMPER, boost=MIX_BOOST)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place; a null or empty text is a piece of its end token alone."""
    attach(spark)
    return packing.best_fit_packing(docs, packing.default_tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mixture),
    ("best-fit packing", sequences),
]

#: A classifier and a tokenizer can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
