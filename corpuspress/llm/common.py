"""Helpers that the training-data operators share.

Texts reach Python as Arrow batches.  Kernels work on the UTF-8 buffer of a
whole batch at once (numpy over bytes), never row by row, and a batch is cut
into slices of bounded bytes so that a worker's memory doesn't depend on the
batch that Spark happens to send.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words: the complement of ``[^\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share.

    ``spark.checkpoint.dir`` is read from the session; where it is unset, a local
    folder is used and set if the master is a single process, else it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if current.isDefined():
            base = current.get()
        elif master == "local" or master.startswith("local["):
            base = "file://" + tempfile.mkdtemp(prefix="corpuspress-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files survive the loss of any executor, so a later stage never has to
    recompute what came before.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``taken`` is called so (case aside)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def local_path(url: str) -> str:
    """The file-system path of a ``file:`` URL (a mounted shared folder)."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    if "://" in url:
        raise ValueError(f"archives need a mounted shared folder, not {url}")
    return url


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if not len(column):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers wait for their next task, several to an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of text, one row at least."""
    try:
        yield from _slices(batches, column, most_bytes)
    finally:
        give_back()


def _slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


class Words:
    """Words of a batch of texts.

    ``start``/``end``: byte ranges in ``data``; ``doc``: row of each word;
    ``first``: n + 1 offsets of each row's words; ``ids()``: dense word ids,
    exact (dictionary encoding, no hashing to a fixed width).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = np.ones(len(data) + 1, bool)
        word[:-1] = ~SPACE[data]
        word[-1] = False
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cuts = offsets[1:-1]
        begins[cuts] |= word[cuts]
        ends = word[:-1] & ~word[1:]
        cuts = cuts[cuts > 0] - 1
        ends[cuts] |= word[cuts]
        self.word = word[:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def array(self, data: np.ndarray | None = None) -> pa.LargeBinaryArray:
        """The words as an Arrow array, from ``data`` if given (same places)."""
        kept = (self.data if data is None else data)[self.word]
        ends = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=ends[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept))])

    def ids(self, data: np.ndarray | None = None) -> np.ndarray:
        return self.array(data).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges ``first[i]:first[i + 1]``, 0 for empty ones."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def hash_filter(keys: DataFrame, column: str, most_bits: int = 1 << 26):
    """A cheap pre-filter: a function of a bigint column that is true for every key of ``keys`` and few others.

    A bitset of at most ``most_bits`` bits, so what reaches the driver and the
    workers is bounded; with more keys it lets more rows through, never fewer.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    n = keys.count()
    bits = min(most_bits, 1 << max(10, (16 * max(n, 1)).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(T.BooleanType())
    def maybe(p: pa.Array) -> pa.Array:
        at = p.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return lambda c: maybe(F.pmod(F.xxhash64(c), F.lit(bits)))
