import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpuspress import queries
from support import SF, compare_with_sql


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    compare_with_sql(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_rows(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert found.count() > 0


def test_entry(spark):
    assert set(queries.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 4


def test_relations(spark):
    q = queries.QUERIES
    assert q["compare_suite"](spark, SF).where("n_wrong > 0").count() == 0
    f = q["factors_lcpcomp"](spark, SF)
    assert f.where("n_replaced > n_bytes + 1").count() == 0
    text = q["text_profile"](spark, SF).where("huff_bits < h0 OR huff_bits > h0 + 1").count()
    assert text == 0
    assert q["flatten_depth"](spark, SF).count() == 200


def test_comparison_has_the_whole_suite(spark):
    found = {r["algorithm"] for r in queries.QUERIES["compare_suite"](spark, SF).collect()}
    assert len(found) == 15
    assert {"gzip -1", "gzip -9", "bzip2 -1", "bzip2 -9", "lzma -1", "lzma -9"} < found
    assert {"lz78u(coder=bit, threshold=5, comp=buffering(huff))", "lcpcomp(coder=sle, threshold=5, comp=heap, dec=compact)"} < found


def test_longest_previous_factor_of_documents(spark):
    docs = queries.table(spark, SF, "documents").where("text IS NOT NULL").select("doc_id", "text")
    sizes = {r["doc_id"]: len(r["text"].encode()) for r in docs.collect()}
    found = queries.QUERIES["longest_previous_factor"](spark, SF)
    assert {r["doc_id"]: r["count"] for r in found.groupBy("doc_id").count().collect()} == {i: n + 1 for i, n in sizes.items()}
    some = sorted(sizes, key=lambda i: (sizes[i], i))[:20]
    texts = {r["doc_id"]: r["text"].encode() for r in docs.where(F.col("doc_id").isin(some)).collect()}
    got = {(r["doc_id"], r["i"]): r["lpf"] for r in found.where(F.col("doc_id").isin(some)).collect()}
    for k, b in texts.items():
        for i in range(len(b)):
            size = 0
            while i + size < len(b) and b.find(b[i : i + size + 1], 0, i + size) >= 0:
                size += 1
            assert got[k, i] == size


def test_no_query_knows_the_training_operators():
    folder = os.path.dirname(os.path.abspath(queries.__file__))
    for root, dirs, files in os.walk(folder):
        dirs[:] = [d for d in dirs if d != "llm"]
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(root, f)) as source:
                    assert "import llm" not in (text := source.read()) and "from .llm" not in text and "corpuspress.llm" not in text
