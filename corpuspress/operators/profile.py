"""Text characteristics: histograms, runs, entropies, k-mers, code lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coders import code_lengths
from .index import indexed
from .transforms import rle, run_starts


def per_text(df: DataFrame, id_col: str, text_col: str, out: dict[str, str], measure: Callable[[bytes], tuple]) -> DataFrame:
    """One row for each text that isn't null: the id and what ``measure`` returns for its bytes."""
    source = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__b")).where("__b IS NOT NULL")
    key = source.schema[0]
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(b) for b in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds[t]) for c, t in zip(columns, out.values()))], [key.name, *out])

    return source.mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, " + ", ".join(f"{k} {t}" for k, t in out.items()))


def expanded(df: DataFrame, group: list[str], text_col: str, k: int) -> DataFrame:
    """group, g (k bytes as a number), n: k-mer counts, summed in each task before they are sent on."""
    source = df.select(*group, F.col(text_col).cast("binary").alias("__b")).where("__b IS NOT NULL")
    fields = source.schema.fields[:-1]

    def count(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(data, np.uint8)
        if k == 1:
            n = np.bincount(a, minlength=256)
            g = np.flatnonzero(n)
            return g, n[g]
        code = np.zeros(max(0, len(a) - k + 1), np.int64)
        for j in range(k):
            code = code << 8 | a[j : len(a) - k + 1 + j]
        return np.unique(code, return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count(b) for b in batch.column(len(group)).to_pylist()]
            again = pa.array(np.repeat(np.arange(len(found)), [len(g) for g, _ in found]).astype(np.int64))
            g = np.concatenate([g for g, _ in found]) if found else np.zeros(0, np.int64)
            n = np.concatenate([n for _, n in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(c.take(again) for c in batch.columns[:-1]), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], [*group, "g", "n"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "g bigint, n bigint"
    return source.mapInArrow(run, schema).groupBy(*group, "g").agg(F.sum("n").alias("n"))


def byte_histogram(df: DataFrame, group: list[str], text_col: str = "text") -> DataFrame:
    return expanded(df, group, text_col, 1).withColumnRenamed("g", "c")


def context_entropy(data: bytes, k: int) -> float:
    """Empirical entropy of order k in bits a byte: that of the bytes that follow each context of k bytes."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(a) <= k:
        return 0.0
    code = np.zeros(len(a) - k, np.int64)
    for j in range(k + 1):
        code = code << 8 | a[j : len(a) - k + j]
    grams, n = np.unique(code, return_counts=True)
    _, at = np.unique(grams >> 8, return_inverse=True)
    whole = np.bincount(at, n)[at]
    return float((n * np.log2(whole / n)).sum() / len(a))


def entropies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    return per_text(df, id_col, text_col, {f"h{k}": "double" for k in orders}, lambda b: tuple(context_entropy(b, k) for k in orders))


def longest_run(data: bytes) -> tuple[int, int]:
    starts = run_starts(np.frombuffer(data, np.uint8))
    size = np.diff(np.append(starts, len(data)))
    return len(starts), int(size.max(initial=0))


def byte_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return per_text(df, id_col, text_col, {"n_runs": "bigint", "longest_run": "bigint"}, longest_run)


def rle_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return per_text(df, id_col, text_col, {"raw_bytes": "bigint", "rle_bytes": "bigint"}, lambda b: (len(b), len(rle(b))))


def huffman_bits(data: bytes) -> int:
    """Bits of the literals under a Huffman code of their own (no header)."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    counts = {s: int(n[s]) for s in np.flatnonzero(n).tolist()}
    lengths = code_lengths(counts)
    return sum(counts[s] * lengths[s] for s in counts) if len(counts) > 1 else 8 * len(data)


def code_table(histogram: DataFrame, group: list[str]) -> DataFrame:
    """group, c, n, bits: Huffman code lengths of each group's histogram (at most 256 rows a group)."""
    fields = [histogram.schema[g] for g in group]

    def solve(table: pa.Table) -> pa.Table:
        lengths = code_lengths(dict(zip(table.column("c").to_pylist(), table.column("n").to_pylist())))
        return table.select([*group, "c", "n"]).append_column("bits", pa.array([lengths[c] for c in table.column("c").to_pylist()], pa.int64()))

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "c bigint, n bigint, bits bigint"
    return histogram.groupBy(*group).applyInArrow(solve, schema)


def text_profile(df: DataFrame, group: list[str], text_col: str = "text") -> DataFrame:
    """For each group: bytes, alphabet size, order-0 entropy, bits a byte under Huffman, from one pre-aggregated histogram."""
    table = code_table(byte_histogram(df, group, text_col), group)
    total = F.sum("n")
    return table.groupBy(*group).agg(
        total.alias("n_bytes"), F.count("*").alias("sigma"),
        F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 9).alias("h0"),
        F.round(F.sum(F.col("n") * F.col("bits")) / total, 9).alias("huff_bits"),
    )


def sle_ranking(df: DataFrame, group: list[str], text_col: str = "text") -> DataFrame:
    """Bytes of each group ranked by count, then value."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(F.desc("n"), "c")
    return byte_histogram(df, group, text_col).withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))


def characteristics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What says how compressible a text is: alphabet, largest and average common prefix, runs of the transform, phrases of the exact parse, entropies of order 0 to 3.

    Null texts have no row; an empty one has zeros (its closing zero alone is one run and one phrase).
    """
    source = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__b")).where("__b IS NOT NULL")
    key = source.schema[0]
    names = ["sigma", "max_lcp", "avg_lcp", "bwt_runs", "z", "h0", "h1", "h2", "h3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for at, x in indexed(raw):
                first = x.offsets[:-1]
                n, part = len(first), raw[at : at + len(first)]
                change = np.append(True, x.bwt[1:] != x.bwt[:-1])
                change[first] = True
                longest, z = x.lpf.tolist(), []
                for a, b in zip(first.tolist(), x.offsets[1:].tolist()):
                    count = 0
                    while a < b:
                        a += max(1, longest[a])
                        count += 1
                    z.append(count)
                size = np.array([len(t) for t in part])
                doc = np.repeat(np.arange(n), size)
                data = np.frombuffer(b"".join(part), np.uint8).astype(np.int64)
                sigma, orders, code = np.zeros(n, np.int64), [], doc
                for k in range(4):
                    m = len(data) - k
                    code = code[:m] * 256 + data[k:] if m > 0 else code[:0]
                    inside = code[doc[:m] == doc[k:]] if m > 0 else code
                    grams, times = np.unique(inside, return_counts=True)
                    own = grams >> (8 * (k + 1))
                    _, context = np.unique(grams >> 8, return_inverse=True)
                    whole = np.bincount(context, times)[context] if len(grams) else times
                    orders.append(np.bincount(own, times * np.log2(whole / times), n) / np.maximum(size, 1))
                    if k == 0:
                        sigma = np.bincount(own, minlength=n)
                lcp = np.maximum.reduceat(x.lcp, first), np.add.reduceat(x.lcp, first) / np.diff(x.offsets)
                columns = [sigma, lcp[0], lcp[1], np.add.reduceat(change.astype(np.int64), first), np.array(z), *orders]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(c) for c in columns)], [key.name, *names])

    kinds = ["bigint", "bigint", "double", "bigint", "bigint", *["double"] * 4]
    return source.mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
