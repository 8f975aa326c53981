"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in numpy over Arrow batches.  The trees
are fitted on the driver on at most ``max_train_rows`` labelled rows (those with
the smallest id hashes, so a bounded and repeatable sample); labels outside the
sample aren't used, and every document is scored.  A fitted model is three flat
arrays, a complete binary tree per round, and a batch walks all trees at once,
level by level.

Defined cases: a null text is an empty one and is scored like any other; without
a usable label the score is 0.5, with labels of one class it is near that class;
null labels teach nothing; of several labels for one id each counts; rows that
repeat, or share or lack an id, are scored each on its own (a null id is not
held out); a very long text is one row of one batch (some 60 bytes of memory a
byte); an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, quality_rules

CLASSES = ("upper", "lower", "digit", "symbol", "pipe", "bang", "stop", "quote", "space", "newline", "wide", "rest")
_CLASS = np.full(256, CLASSES.index("rest"), np.int64)
for _name, _bytes in (
    ("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("symbol", b"#*$%&<>@^~=+_\\/{}[]"), ("pipe", b"|"),
    ("bang", b"!?"), ("stop", b".,;:"), ("quote", b"'\"()-`"), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("wide", range(192, 256)),
):
    _CLASS[list(_bytes)] = CLASSES.index(_name)
_CLASS[128:192] = len(CLASSES)  # the further bytes of a code point

FEATURES = (
    *(f"share_{c}" for c in CLASSES), "log_chars", "log_words", "word_length", "word_length_spread", "long_words", "short_words", "distinct_words",
    "distinct_pairs", "top_word", "same_as_before", "log_lines", "words_a_line", "repeated_lines", "capital_words", "stop_ends",
)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    data, offsets = common.text_buffer(column)
    n, k = len(offsets) - 1, len(CLASSES) + 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    by_class = np.bincount(row * k + _CLASS[data], minlength=n * k).reshape(n, k)[:, :-1]
    chars = by_class.sum(1)
    words = common.Words(data, offsets)
    count = words.count
    some = np.maximum(count, 1)
    wide = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=wide[1:])
    length = wide[words.end] - wide[words.start]
    total = common.per_row(length, words.first)
    mean = total / some
    spread = np.sqrt(np.maximum(common.per_row(length * length, words.first) / some - mean**2, 0))
    ids = words.ids() if len(words.doc) else np.zeros(0, np.int64)
    v = int(ids.max()) + 1 if len(ids) else 1
    key = words.doc * v + ids
    distinct, times = np.unique(key, return_counts=True)
    n_distinct = np.bincount(distinct // v, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, distinct // v, times)
    pair = np.flatnonzero(words.doc[1:] == words.doc[:-1]) if len(key) else np.zeros(0, np.int64)
    pairs = np.bincount(words.doc[pair], minlength=n)
    two = np.searchsorted(distinct, key)
    n_pairs = np.bincount(words.doc[pair[np.unique(two[pair] * (len(distinct) + 1) + two[pair + 1], return_index=True)[1]]], minlength=n)
    same = np.bincount(words.doc[pair[ids[pair] == ids[pair + 1]]], minlength=n)
    lines = by_class[:, CLASSES.index("newline")] + 1
    first, last = (data[words.start], data[words.end - 1]) if len(key) else (np.zeros(0, np.uint8),) * 2
    columns = [
        *(by_class / np.maximum(chars, 1)[:, None]).T, np.log1p(chars), np.log1p(count), mean, spread, common.per_row(length > 14, words.first) / some,
        common.per_row(length <= 2, words.first) / some, n_distinct / some, n_pairs / np.maximum(pairs, 1), top / some, same / np.maximum(pairs, 1),
        np.log1p(lines), count / lines, quality_rules.duplicate_lines(words) / lines, common.per_row((first >= 65) & (first <= 90), words.first) / some,
        common.per_row(np.isin(last, list(b".,;:")), words.first) / some,
    ]
    return np.stack(columns, 1)


@dataclass
class Trees:
    """Flat trees: node i has the children 2i + 1 and 2i + 2; ``cut`` 255 sends all to the left."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], "left")
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        n, rounds = len(x), len(self.leaf)
        total = np.full(n, self.base)
        if rounds:
            bins, tree, row = self.binned(x), np.arange(rounds)[None, :], np.arange(n)[:, None]
            node = np.zeros((n, rounds), np.int64)
            inner = self.feature.shape[1]
            while inner > 0 and (node[0, 0] < inner if n else False):
                node = 2 * node + 1 + (bins[row, self.feature[tree, node]] > self.cut[tree, node])
            total = total + self.leaf[tree, node - inner].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, ridge: float = 2.0, least: float = 3.0) -> Trees:
    """Boost logistic loss; split gains come from histograms of gradients and hessians."""
    n, f = x.shape
    inner = (1 << depth) - 1
    prior = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(prior / (1 - prior)))
    if n == 0 or y.min() == y.max():
        return Trees([np.zeros(0)] * f, base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.uint8), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    model = Trees(edges, base, np.zeros((rounds, inner), np.int64), np.full((rounds, inner), 255, np.uint8), np.zeros((rounds, inner + 1)))
    b = model.binned(x).astype(np.int64)
    flat = b + np.arange(f) * bins
    margin = np.full(n, base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, at = 1 << level, (1 << level) - 1
            key = (node[:, None] * (f * bins) + flat).ravel()
            gs, hs = (np.bincount(key, np.repeat(w, f), width * f * bins).reshape(width, f, bins) for w in (g, h))
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least) | (ha - hl < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            model.feature[t, at : at + width] = np.where(good, best // bins, 0)
            model.cut[t, at : at + width] = np.where(good, best % bins, 255)
            node = 2 * node + (b[np.arange(n), model.feature[t, at + node]] > model.cut[t, at + node])
        gsum, hsum = (np.bincount(node, w, inner + 1) for w in (g, h))
        model.leaf[t] = -rate * gsum / (hsum + ridge)
        margin = margin + model.leaf[t][node]
    return model


def held_out(id_col: str, modulus: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = 20_000, **how) -> Trees:
    """Fit on the labelled rows that aren't held out, at most ``max_train_rows`` of them."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    # The sample is at most max_train_rows rows of two numbers: a proven bound for the broadcast.
    sample = usable.orderBy(F.xxhash64("id"), "id", "label").limit(max_train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "id").select("text", "id", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            x = statistics(batch.column(0))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.string()), batch.column(2), values], ["id", "label", "x"])

    # An id may be there many times: each task hands on max_train_rows rows at most, and so many come to the driver.
    found = joined.mapInArrow(run, "id string, label int, x array<double>")
    rows = found.orderBy(F.xxhash64("id"), "id", "label", "x").limit(max_train_rows).toPandas()
    rows["key"] = [tuple(v) for v in rows["x"]]
    rows = rows.sort_values(["id", "label", "key"])
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].clip(0, 1).to_numpy(float), **how)


def score(docs: DataFrame, model: Trees, keep: list[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """The columns ``keep`` and each text's score, as column ``out``."""
    (text,) = common.free([*keep, out], "text")
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(text))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            found = model.score(statistics(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*batch.schema.names[:-1], out])

    return source.mapInArrow(run, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs, common.read(spark, sf_dir, "labels"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
