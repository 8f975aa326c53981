"""Quality rules: repetition inside a document, found by a suffix array.

The words of a document are sorted as suffixes (prefix doubling), common-prefix
intervals of the LCP array give the maximal repeated word sequences, and the
union of their spans and the longest of them are limited.  Documents are
independent, so there is no shuffle: one Arrow pass over the texts.

Defined cases: a null text is an empty one; a text without words has zeros in
every count and fails the base rule; rows that repeat, or share or lack an id,
are judged each on its own; a very long text is one suffix array (some 100 bytes
of memory a word); an empty table gives no rows; other columns of the input are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, suffix

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def duplicate_lines(words: common.Words) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the same text."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([breaks + 1, offsets[:-1]]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    has_break = data[ends - 1] == 10 if len(ends) else np.zeros(0, bool)
    sizes = ends - starts - has_break
    has_word = per_range(words.word, starts, ends) > 0
    doc = np.searchsorted(offsets, starts, "right") - 1
    places = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=places[1:])
    kept = np.ascontiguousarray(data[data != 10])
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(kept)])
    ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc, ids = doc[has_word], ids[has_word]
    n = len(offsets) - 1
    distinct = np.unique(doc * (len(sizes) + 1) + ids) // (len(sizes) + 1)
    return np.bincount(doc, minlength=n) - np.bincount(distinct, minlength=n)


def per_range(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def innermost(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n slots the number of the smallest of nested intervals that holds it, -1 if none does; linear however deep they nest."""
    mark, ends, stack = [-2] * (n + 1), right.tolist(), []
    begins = left.tolist()
    for j in np.lexsort((-right, left)).tolist():
        while stack and ends[stack[-1]] < begins[j]:
            at = ends[stack.pop()] + 1
            mark[at] = stack[-1] if stack else -1
        stack.append(j)
        mark[begins[j]] = j
    while stack:
        at = ends[stack.pop()] + 1
        mark[at] = stack[-1] if stack else -1
    value = np.array(mark[:n], np.int64)
    known = np.maximum.accumulate(np.where(value > -2, np.arange(n), -1))
    return np.where(known >= 0, value[np.maximum(known, 0)], -1)


def spans_covered(sa: np.ndarray, left: np.ndarray, right: np.ndarray, deep: np.ndarray, n: int) -> np.ndarray:
    """Marks each position in the union of the spans of all occurrences of the intervals.

    The intervals around a slot of the array are nested, and their spans begin at
    the same position: the innermost one has the longest.
    """
    own = innermost(left, right, n)
    hit = np.flatnonzero(own >= 0)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, sa[hit], 1)
    np.add.at(edge, sa[hit] + deep[own[hit]], -1)
    return np.cumsum(edge[:-1]) > 0


def repetition(words: common.Words, window: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: words covered by repeats of ``window`` words, of ``least`` words; longest repeat."""
    n = len(words.count)
    longest = np.zeros(n, np.int64)
    if not len(words.doc):
        return longest, longest, longest
    ids = words.ids()
    symbols = words.doc * (int(ids.max()) + 1) + ids
    sa, levels = suffix.sort_suffixes(symbols, words.doc)
    lcp = suffix.neighbour_lcp(sa, levels, words.first[1:][words.doc])
    np.maximum.at(longest, words.doc[sa[lcp > 0]], lcp[lcp > 0])  # the depth of the deepest interval
    before = np.append(-1, symbols[:-1])
    before[words.first[:-1][words.count > 0]] = -1 - np.flatnonzero(words.count > 0)
    left, right, deep = suffix.maximal_repeats(sa, lcp, before, min(window, least))
    covers = [common.per_row(spans_covered(sa, *(x[deep >= m] for x in (left, right, deep)), len(sa)), words.first) for m in (window, least)]
    return (*covers, longest)


def measure(column: pa.Array, window: int = 3, least: int = 8) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text of a batch."""
    data, offsets = common.text_buffer(column)
    words = common.Words(data, offsets)
    repeat, cover, longest = repetition(words, window, least)
    return {
        "n_words": words.count,
        "word_chars": common.per_row(words.word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": common.per_row(SYMBOLS[data], offsets),
        "n_dup_lines": duplicate_lines(words),
        "n_repeat_words": repeat,
        "covered_words": cover,
        "longest_repeat": longest,
    }


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    least_repeat: int = 8,
    max_covered_percent: int = 30,
    max_longest_repeat: int = 32,
) -> DataFrame:
    """Counts and the verdict for each document.

    ``base_failed``: fewer than ``min_words`` words, or over
    ``max_repeat_percent`` of them in 3-word windows found twice.  ``kept``: the
    base rule holds, repeats of ``least_repeat`` words or more cover at most
    ``max_covered_percent`` of the words, and none is longer than
    ``max_longest_repeat`` words.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = measure(batch.column(1), 3, least_repeat)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])

    counted = narrow.mapInArrow(run, f"doc_id {key}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    held = (100 * F.col("covered_words") <= max_covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= max_longest_repeat)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & held)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.read(spark, sf_dir, "documents")).drop("longest_repeat")


#: Same counts from word windows: a word is in a repeat of m words just if one of the windows of m words over it is found twice.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
g AS (SELECT rid, i,
        CASE WHEN i + 2 <= len(ws) THEN array_to_string(ws[i:i + 2], ' ') END AS g3,
        CASE WHEN i + 7 <= len(ws) THEN array_to_string(ws[i:i + 7], ' ') END AS g8,
        CASE WHEN i + 32 <= len(ws) THEN md5(array_to_string(ws[i:i + 32], ' ')) END AS g33 FROM p),
m AS (SELECT rid, i,
        CASE WHEN g3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, g3) > 1 THEN 1 ELSE 0 END AS d3,
        CASE WHEN g8 IS NOT NULL AND count(*) OVER (PARTITION BY rid, g8) > 1 THEN 1 ELSE 0 END AS d8,
        CASE WHEN g33 IS NOT NULL AND count(*) OVER (PARTITION BY rid, g33) > 1 THEN 1 ELSE 0 END AS d33 FROM g),
c AS (SELECT rid,
        max(d3) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
        max(d8) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8, d33 FROM m),
r AS (SELECT rid, sum(c3) AS n_repeat_words, sum(c8) AS covered_words, max(d33) AS too_long FROM c GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
e AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
a AS (SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(e.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(r.covered_words, 0) AS BIGINT) AS covered_words, coalesce(r.too_long, 0) AS too_long
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN e USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
  NOT base_failed AND 100 * covered_words <= 30 * n_words AND too_long = 0 AS kept FROM b
"""
