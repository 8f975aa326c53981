import pytest
from pyspark.sql import functions as F

from corpuspress.operators.stats import Phases, phase_rows
from corpuspress.sources import corpus, generators


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\0abcdef")
    (tmp_path / "b.bin").write_bytes(b"")
    rows = {r["path"].rsplit("/", 1)[1]: bytes(r["data"]) for r in corpus.read_files(spark, str(tmp_path), 1, 4).collect()}
    assert rows == {"a.bin": b"abc"}  # Spark's scan leaves empty files out
    assert corpus.read_texts(spark, str(tmp_path / "a.bin")).first()["text"] == "\0abcdef"


def test_overwrite_guard(spark, tmp_path):
    df = spark.range(3)
    corpus.write_blobs(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        corpus.write_blobs(df, str(tmp_path / "out"))
    corpus.write_blobs(spark.range(5), str(tmp_path / "out"), force=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_prefix_and_sample(spark):
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(100)] + [(100, None)], "doc_id bigint, text string")
    got = [(r["doc_id"], r["cum_bytes"]) for r in corpus.prefix(df, 120, bucket_ids=8).orderBy("doc_id").collect()]
    total, want = 0, []
    for i in range(101):
        total += i % 7 if i < 100 else 0
        if total <= 120:
            want.append((i, total))
    assert got == want
    assert corpus.sample(df, 120).agg(F.max("cum_bytes")).first()[0] <= 120
    assert corpus.prefix(df.limit(0), 10).count() == 0


def test_pages_and_lines(spark):
    df = spark.createDataFrame([(1, '<a href="/A">x</a><a href="/A">y</a><a href="/Talk:B">z</a><!-- <b> --><script>1<2</script> t')], "page_id int, html string")
    assert [tuple(r) for r in corpus.links(df).collect()] == [("A", 1)]
    assert df.select(corpus.strip_markup(F.col("html"))).first()[0] == "x y z t"
    lines = spark.createDataFrame([("a\nb\n\na",), (None,)], "text string")
    assert sorted((r["line"], r["n"]) for r in corpus.distinct_lines(lines).collect()) == [("a", 2), ("b", 1)]


def test_generators(spark):
    assert generators.fibonacci(7) == b"abaababaabaab" and generators.fibonacci(1) == b"b"
    assert generators.thue_morse(5) == b"0110100110010110" and generators.thue_morse(0) == b"0"
    rows = "".join(str(r["bit"]) for r in generators.thue_morse_rows(spark, 8).orderBy("i").collect())
    assert rows.encode() == generators.thue_morse(8)
    assert generators.uniform(50, 3) == generators.uniform(50, 3) and set(generators.uniform(500, 1, 65, 66)) == {65, 66}


def test_phases(spark):
    p = Phases("all")
    with p("one"):
        p.log("n", 3)
        with p("inner"):
            pass
    rows = {r["path"]: r for r in phase_rows(spark, p.to_json()).collect()}
    assert set(rows) == {"/all", "/all/one", "/all/one/inner"} and rows["/all/one"]["stats"] == {"n": "3"}
