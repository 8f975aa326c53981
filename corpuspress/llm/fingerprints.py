"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 48-bit hashes of a text's 3-word shingles,
written as a base64 string.  Sketches of parts merge into the sketch of the
whole, and two of them estimate resemblance, containment and the number of
distinct shingles; with fewer than k shingles every estimate is exact.

Pairs of neighbours in id order are formed without a global window: ids are cut
into ranges at sampled bounds (which set the balance, never the result), a row
goes to its range, and each range also gets a copy of the next range's first
row, so the texts are shuffled once and a task reads two rows at a time.

Defined cases: a null text is an empty one; a text of fewer than three words is
one shingle, one without words has the empty fingerprint; two empty fingerprints
are alike (1), an empty and another are not (0); rows that share an id follow one
another in the order of their texts; a null id comes last; a single document is
its own successor; a very long text is one row, held with its successor; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

K, WIDTH = 128, 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOW48 = np.uint64((1 << 48) - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: common.Words, data: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of all words; each distinct word is hashed once a batch."""
    if not len(words.doc):
        return np.zeros(0, np.uint64)
    encoded = words.array(data).dictionary_encode()
    own = np.fromiter(map(xxhash.xxh64_intdigest, encoded.dictionary.to_pylist()), np.uint64, len(encoded.dictionary))
    return own[encoded.indices.to_numpy(zero_copy_only=False)]


def shingle_hashes(words: common.Words, width: int = WIDTH, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of ``width`` words; a shorter text with words is one shingle."""
    h, first, count = word_hashes(words, data), words.first, words.count
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[:-1][row]
    have = np.minimum(count, width)[row]
    out = have.astype(np.uint64)
    for j in range(width):
        inside = j < have
        out = np.where(inside, mixed((out + h[np.where(inside, at + j, 0)]) * _A + _B), out) if len(h) else out
    return row, out


def sketches(column: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """n + 1 offsets and the sorted hashes of each text's sketch."""
    data, offsets = common.text_buffer(column)
    row, h = shingle_hashes(common.Words(data, offsets))
    n = len(offsets) - 1
    out, first = [], [0]
    for at in range(0, n, 1 << 16):  # a row number has 16 bits beside a hash
        lo, hi = np.searchsorted(row, [at, at + (1 << 16)])
        key = np.sort(((row[lo:hi] - at).astype(np.uint64) << np.uint64(48)) | (h[lo:hi] & LOW48))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        own = (key >> np.uint64(48)).astype(np.int64)
        begin = np.searchsorted(own, np.arange(min(n - at, 1 << 16) + 1))
        keep = np.arange(len(key)) - begin[own] < k
        out.append(key[keep] & LOW48)
        first += (first[-1] + np.cumsum(np.minimum(np.diff(begin), k))).tolist()
    return np.array(first), np.concatenate(out) if out else np.zeros(0, np.uint64)


def to_strings(first: np.ndarray, hashes: np.ndarray) -> list[str]:
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return [base64.b64encode(raw[6 * a : 6 * b]).decode() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def from_string(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def to_string(hashes: np.ndarray) -> str:
    return to_strings(np.array([0, len(hashes)]), hashes)[0]


def merge(a: str, b: str, k: int = K) -> str:
    """The fingerprint of the union of two sets of shingles."""
    return to_string(np.unique(np.concatenate([from_string(a), from_string(b)]))[:k])


def distinct_count(fingerprint: str, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    h = from_string(fingerprint)
    return float(len(h)) if len(h) < k else (k - 1) / ((float(h[k - 1]) + 1) / 2.0**48)


def resemblance(a: str, b: str, k: int = K) -> float:
    x, y = from_string(a), from_string(b)
    return float(likeness(np.array([0, len(x)]), x, np.array([0, len(y)]), y, k)[0])


def containment(a: str, b: str, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    j, n = resemblance(a, b, k), distinct_count(a, k)
    both = j * distinct_count(merge(a, b, k), k)
    return min(1.0, both / n) if n else 1.0


def sizes(first: np.ndarray, hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Estimated number of distinct shingles behind each sketch; exact below k."""
    n = np.diff(first)
    out, full = n.astype(float), np.flatnonzero(n >= k)
    out[full] = (k - 1) / ((hashes[first[full] + k - 1].astype(float) + 1) / 2.0**48)
    return out


def likeness(fa: np.ndarray, a: np.ndarray, fb: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Estimated Jaccard of the sketches fa[i]:fa[i + 1] of a and the same of b, for all i."""
    return compared(fa, a, fb, b, k)[0]


def compared(fa: np.ndarray, a: np.ndarray, fb: np.ndarray, b: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """``likeness``, and the estimated share of a's shingles that b has, from the merged sketches."""
    n = len(fa) - 1
    out, whole = np.zeros(n), np.zeros(n)
    for at in range(0, n, 1 << 16):
        end = min(n, at + (1 << 16))
        parts = []
        for f, h in ((fa, a), (fb, b)):
            row = np.repeat(np.arange(end - at, dtype=np.uint64), np.diff(f[at : end + 1]))
            parts.append((row << np.uint64(48)) | h[f[at] : f[end]])
        key, times = np.unique(np.concatenate(parts), return_counts=True)
        own = (key >> np.uint64(48)).astype(np.int64)
        begin = np.searchsorted(own, np.arange(end - at + 1))
        # Two sketches below k hold their whole sets, so all of the union counts.
        most = np.where((np.diff(fa[at : end + 1]) < k) & (np.diff(fb[at : end + 1]) < k), 2 * k, k)
        low = np.arange(len(key)) - begin[own] < most[own]
        union = np.minimum(np.diff(begin), most)
        both = np.bincount(own[low], times[low] == 2, end - at)
        out[at:end] = np.where(union > 0, both / np.maximum(union, 1), 1.0)
        # The merged sketch: the smallest of both, all of them where both hold whole sets.
        held = np.diff(begin)
        part = held > most
        whole[at:end] = held
        full = np.flatnonzero((held >= k) & (part | (most == k)))
        whole[at + full] = (k - 1) / (((key[begin[full] + k - 1] & LOW48).astype(float) + 1) / 2.0**48)
    own = sizes(fa, a, k)
    return out, np.where(own > 0, np.minimum(1.0, out * whole / np.maximum(own, 1)), 1.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id and fingerprint of each text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_strings(*sketches(batch.column(1), k)))], ["doc_id", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def in_order(docs: DataFrame, rows_a_range: int = 2500) -> DataFrame:
    """Rows (range, tail, doc_id, text) so partitioned and sorted that each row with tail 0 is followed by its successor."""
    spark = docs.sparkSession
    n = docs.count()
    rows_a_range = max(rows_a_range, n // 100_000)
    ranges = max(1, n // rows_a_range)
    # Bounds only balance the ranges: a bounded sample of ids serves.
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    if ranges > 1:
        share = min(1.0, 20 * ranges / n)
        sample = np.sort(np.array([r[0] for r in ids.sample(share, 7).collect()], np.int64))
    else:
        sample = np.zeros(0, np.int64)
    bounds = np.unique(sample[np.linspace(0, len(sample) - 1, ranges + 1).astype(int)[1:-1]]) if len(sample) else sample
    number = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf(T.IntegerType())
    def range_of(x: pa.Array) -> pa.Array:
        b = number.value
        valid = x.is_valid().to_numpy(zero_copy_only=False)
        at = len(b) - np.searchsorted(b, x.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(valid, at, len(b) + 1), pa.int32())

    # The first row of each range: at most one row a range comes to the driver.
    top = ids.select("doc_id", range_of("doc_id").alias("range")).groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()
    heads = sorted((r["range"], r["doc_id"]) for r in top)
    if docs.where("doc_id IS NULL").limit(1).count():
        heads.append((len(bounds) + 1, None))
    moves = [(heads[(i + 1) % len(heads)][1], r) for i, (r, _) in enumerate(heads)]
    to = spark.createDataFrame(moves, "head bigint, range int")
    copies = docs.join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("range", "doc_id").agg(F.min("text").alias("text"))
    rows = docs.select(range_of("doc_id").alias("range"), F.lit(0).alias("tail"), "doc_id", "text").union(copies.select("range", F.lit(1).alias("tail"), "doc_id", "text"))
    return rows.repartition(max(1, len(heads) // 2), "range").sortWithinPartitions("range", "tail", F.desc_nulls_last("doc_id"), "text")


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and its edited text (its second half replaced by as much of its successor's beginning).

    Estimates: ``near_edited`` and ``near_next`` (resemblance), ``n_shingles`` (distinct shingles), ``kept_in_edited``
    (the share of the text's shingles that the edited text has).
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in common.slices(batches, "text"):
            tail, ids, texts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            if held is not None:
                tail, ids, texts = [held[0], *tail], [held[1], *ids], [held[2], *texts]
            held = (tail[-1], ids[-1], texts[-1]) if not tail[-1] else None
            rows = [i for i in range(len(tail) - 1) if not tail[i]]
            edited, size = [], []
            for i in rows:
                n = len(texts[i])
                size.append(n)
                edited.append(texts[i][: n - n // 2] + texts[i + 1][: n // 2])
            f, h = sketches(pa.array(texts, pa.string()), k)
            fe, he = sketches(pa.array(edited, pa.string()), k)
            own, after = select(f, h, np.array(rows, np.int64)), select(f, h, np.array(rows, np.int64) + 1)
            near, kept = compared(*own, fe, he, k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in rows], pa.int64()), pa.array(size, pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array(to_strings(*own), pa.string()), pa.array(to_strings(fe, he), pa.string()), pa.array(near), pa.array(likeness(*own, *after, k)), pa.array(sizes(*own, k)), pa.array(kept),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "kept_in_edited"],
            )

    return in_order(source).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, kept_in_edited double")


def select(first: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of some rows."""
    size = first[rows + 1] - first[rows] if len(rows) else np.zeros(0, np.int64)
    out = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(out[-1]) - np.repeat(out[:-1], size) + np.repeat(first[rows] if len(rows) else size, size)
    return out, hashes[at]


def op5_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_successor(common.read(spark, sf_dir, "documents"))
