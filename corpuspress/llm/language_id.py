"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes with symbol
counts.  A byte is coded in its longest context that the tree has; if it was
never seen there, an escape (method C: distinct symbols over total and distinct)
is coded and the next shorter context is asked, down to a uniform byte.  The
statistics are frozen after training, so the code length of a byte given its
three predecessors is a fixed number: it is tabulated for each known four bytes
and the exact code length of a whole text is a sum of table look-ups.  The
language with the shortest code wins.

Training counts four-byte strings over all training texts: tasks pre-aggregate
in numpy, Spark adds the counts up, so what is moved follows the input.  The counts
of shorter strings, and the totals of contexts, are sums over all of them.  Nodes
for single strings are kept for the ``max_nodes`` most frequent strings of each
length, whatever their language, which bounds the model that is broadcast: up to
that number (327,192 strings of four bytes in 0.5 GB of texts in four languages)
every string is a node and the code lengths are those of the full statistics.
Beyond it, a string that is too rare is coded like one never seen there: by the
escape of its context, with the context's true counts, and in the next shorter
context.  The number of languages has no bound of its own.  Texts are folded to
lower case (ASCII and Latin-1) first and start after three newlines.

Defined cases: a null text or one without a letter is ``und`` with score 0, and
so is every text if nothing was learned; null languages teach nothing; rows with
a null id are training rows; rows that repeat, or share an id, are judged each on
its own; ties go to the language that sorts first; a very long text is one row of
one batch (some 40 bytes of memory a byte); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII letters and the letters of Latin-1 in UTF-8."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[lead] += 32
    return out


def fours(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The four bytes that end at each byte, as a number; a text starts after three newlines."""
    d = folded(data).astype(np.uint32)
    n = len(d)
    code = d.copy()
    starts, size = offsets[:-1], np.diff(offsets)
    for back in (1, 2, 3):
        before = np.full(n, 10, np.uint32)
        before[back:] = d[: n - back]
        for k in range(back):
            at = starts[size > k] + k
            before[at] = 10
        code |= before << np.uint32(8 * back)
    return code


class Index:
    """Open addressing: places of known numbers in an array, looked up in bulk."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(len(codes) * 2).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.values = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(codes))
        at = self.slot(codes)
        while len(left):
            free = self.values[at[left]] < 0
            spot, first = np.unique(at[left][free], return_index=True)
            won = left[free][first]
            self.keys[spot], self.values[spot] = codes[won], won
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of each number, -1 for an unknown one."""
        at = self.slot(codes)
        out = self.values[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != codes))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            got = self.values[at[left]]
            out[left] = got
            left = left[(got >= 0) & (self.keys[at[left]] != codes[left])]
        return out


class Tree:
    """The frozen tree of one language: bits of each symbol in each context that has it, and of the escape from each context.

    ``levels``: for strings of 4, 3 and 2 bytes the known strings, their counts, and the contexts (the
    strings without their last byte) with total and number of distinct symbols; ``ones``: counts of bytes.
    """

    def __init__(self, levels: list[tuple], ones: np.ndarray):
        self.tables = []
        for codes, counts, contexts, totals, distinct in levels:
            all_ = totals + distinct
            at = np.searchsorted(contexts, codes >> np.uint32(8))
            self.tables.append((codes, np.log2(all_[at] / counts).astype(np.float32), contexts, np.log2(all_ / distinct).astype(np.float32)))
        known = np.flatnonzero(ones)
        total = ones.sum() + len(known)
        # The last escape leads to a byte as likely as any other.
        self.bits1 = np.full(256, 8.0 + (np.log2(total / len(known)) if len(known) else 0.0))
        self.bits1[known] = np.log2(total / ones[known])

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four, given the three before it."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for (known, bits, contexts, escapes), mask in zip(self.tables, (0xFFFFFFFF, 0xFFFFFF, 0xFFFF)):
            own = codes[left] & np.uint32(mask)
            at, found = lookup(known, own)
            out[left[found]] += bits[at[found]]
            left, own = left[~found], own[~found]
            at, found = lookup(contexts, own >> np.uint32(8))
            out[left[found]] += escapes[at[found]]
        out[left] += self.bits1[codes[left] & np.uint32(0xFF)]
        return out


def tree_of(codes: np.ndarray, counts: np.ndarray) -> Tree:
    """The tree of all counts of four-byte strings (sorted), with nothing left out."""
    levels = []
    for mask in (0xFFFFFFFF, 0xFFFFFF, 0xFFFF, 0xFF):
        codes, at = np.unique(codes & np.uint32(mask), return_inverse=True)
        counts = np.bincount(at, counts, len(codes))
        contexts, at = np.unique(codes >> np.uint32(8), return_inverse=True)
        levels.append((codes, counts, contexts, np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(float)))
    return Tree(levels[:3], np.bincount(levels[3][0], levels[3][1], 256))


def lookup(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted numbers among sorted ones, and whether they are there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


class Trees:
    """The frozen trees of all languages."""

    def __init__(self, langs: list[str], trees: list[Tree]):
        self.langs, self.trees = langs, trees
        self.known = np.unique(np.concatenate([t.tables[0][0] for t in trees])) if trees else np.zeros(0, np.uint32)
        self.index: Index | None = None

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language: texts x languages."""
        if self.index is None:
            self.index = Index(self.known)
        n, k = len(offsets) - 1, len(self.langs)
        out = np.zeros((n, k))
        if not len(data) or not k:
            return out
        code = fours(data, offsets)
        at = self.index.find(code).astype(np.int64)
        miss = np.flatnonzero(at < 0)
        rare, again = np.unique(code[miss], return_inverse=True)
        at[miss] = len(self.known) + again
        # Each distinct string of the batch is coded once a language.
        used = np.zeros(len(self.known) + len(rare), bool)
        used[at] = True
        number = np.cumsum(used) - 1
        mine = np.flatnonzero(used[: len(self.known)])
        distinct = np.concatenate([self.known[mine], rare])
        at = number[at]
        some = np.flatnonzero(np.diff(offsets) > 0)
        for i, tree in enumerate(self.trees):
            out[some, i] = np.add.reduceat(tree.bits(distinct)[at], offsets[some])
        return out


def counted(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, code, n: how often each language's texts have each four bytes."""
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(lang: str) -> pa.RecordBatch:
            codes, counts = kept.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(codes), np.int64))), pa.array(codes.astype(np.int64)), pa.array(counts)], ["lang", "code", "n"])

        for batch in common.slices(batches, "text"):
            names = batch.column(1).to_numpy(zero_copy_only=False)
            for lang in set(names):
                data, offsets = common.text_buffer(batch.column(0).filter(pa.array(names == lang)))
                codes, counts = np.unique(fours(data, offsets), return_counts=True)
                if lang in kept:
                    codes, at = np.unique(np.concatenate([kept[lang][0], codes]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([kept[lang][1], counts])).astype(np.int64)
                kept[lang] = codes, counts
                if len(codes) > 2_000_000:  # bounded memory: hand on what there is
                    yield out(lang)
        for lang in list(kept):
            yield out(lang)

    return source.mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_nodes: int = 1_000_000) -> Trees:
    """Trees of all languages of ``docs``; strings that are rarer than the ``max_nodes`` most frequent ones count, but aren't kept as nodes."""
    levels = [common.written(counted(docs, text_col, lang_col), "counts")]
    for mask in (0xFFFFFF, 0xFFFF, 0xFF):
        levels.append(common.written(levels[-1].groupBy("lang", F.col("code").bitwiseAND(F.lit(mask)).alias("code")).agg(F.sum("n").alias("n")), "counts"))
    parts = []
    for level in levels[:3]:
        contexts = common.written(level.groupBy("lang", F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("distinct")), "contexts")
        least = least_count(level, max_nodes)
        # At most max_nodes rows of each kind come to the driver; a context has at least the count of each of its strings.
        parts.append((level.where(F.col("n") >= least).toPandas(), contexts.where(F.col("total") >= max(least, least_count(contexts.withColumnRenamed("total", "n"), max_nodes))).toPandas()))
    ones = levels[3].toPandas()
    langs = sorted(ones["lang"].unique())
    trees = []
    for lang in langs:
        tables = []
        for strings, contexts in parts:
            c = contexts[contexts["lang"] == lang].sort_values("context")
            known = c["context"].to_numpy(np.uint32)
            s = strings[strings["lang"] == lang].sort_values("code")
            codes = s["code"].to_numpy(np.uint32)
            _, inside = lookup(known, codes >> np.uint32(8))
            tables.append((codes[inside], s["n"].to_numpy(np.float64)[inside], known, c["total"].to_numpy(np.float64), c["distinct"].to_numpy(np.float64)))
        own = ones[ones["lang"] == lang]
        trees.append(Tree(tables, np.bincount(own["code"].to_numpy(np.int64), own["n"].to_numpy(np.float64), 256)))
    return Trees(langs, trees)


def least_count(rows: DataFrame, most: int) -> float:
    """The least n, in steps of a sixteenth of a doubling, for which at most ``most`` rows have so many."""
    step = F.floor(F.log2("n") * 16).cast("int")
    bins = sorted((r["bin"], r["count"]) for r in rows.groupBy(step.alias("bin")).count().collect())  # 16 * 63 at most
    while bins and sum(c for _, c in bins) > most:
        bins.pop(0)
    return 2.0 ** (bins[0][0] / 16) if bins else float("inf")


def held_out(id_col: str, modulus: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the posterior of the language under equal priors)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in common.slices(batches, "text", 2 << 20):
            bits = trees.bits(*common.text_buffer(batch.column(1)))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if trees.langs:
                best = bits.argmin(1)
                score = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                lang = np.array(trees.langs, object)[best]
            else:
                score, lang = np.zeros(len(bits)), np.full(len(bits), "und", object)
            lang[~letters], score[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    trees = train(docs.where(~held_out("doc_id")))
    return predict(docs, trees).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
