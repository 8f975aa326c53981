"""Small tables with everything that may go wrong."""

import random

from pyspark.sql import types as T

PASSAGE = "the quick brown fox jumps over the lazy dog while seventeen grey herons watch from the reeds beside a slow river that bends twice before the old stone bridge and the mill where nobody has ground any corn for forty years or more"
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use for columns of their own.
    *(T.StructField(c, T.StringType()) for c in ("score", "key", "kept", "n", "gram", "label", "piece", "weight", "range", "salt")),
])


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    body = lambda n: " ".join(word() for _ in range(n))
    a, b = body(120), body(90)
    near = a.split()
    near[60] = "changed"
    long = body(4000)
    return [
        None, "", " ", "\n\n", "word", "two words", a, a, " ".join(near), b + "\n" + PASSAGE, PASSAGE + "\n" + body(40), body(15) + " " + PASSAGE + " " + body(15), long, "x " * 300, "a" * 700,
        "périodique " * 80, "#### $$$$ | | |", (body(12) + "\n") * 9, "日本語テキスト " + body(60), b, None, "", body(64), "Two Words", body(50), "é" * 150 + body(20), "è" * 150 + body(20),
    ]


def messy(spark, seed=1):
    rows = [(i * 3, t, ("en", "de", None)[i % 3], ("s0", "s1", None, "s0")[i % 4], None if t is None else len(t), *["x"] * 10) for i, t in enumerate(texts(seed))]
    rows += [rows[6], rows[6], (None, rows[7][1], "en", "s0", 1, *[None] * 10), (None, "no id here at all", None, None, None, *[None] * 10), (9, "same id, other text", "en", "s1", 3, *["x"] * 10)]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
