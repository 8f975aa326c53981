"""Generated texts: as bytes for tests and as tables for queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fibonacci(n: int) -> bytes:
    a, b = b"b", b"a"
    for _ in range(2, n):
        a, b = b, b + a
    return a if n == 1 else b


def thue_morse(n: int) -> bytes:
    """2 ** (n - 1) digits for n >= 1, one for n = 0."""
    if n > 40:
        raise ValueError("too long for one value; use thue_morse_rows")
    size = 1 << max(0, n - 1)
    v = np.arange(size, dtype=np.uint64)
    return ((np.bitwise_count(v) & 1) + 48).astype(np.uint8).tobytes()


def run_rich(n: int) -> bytes:
    a, b, c = b"0110101101001011010", b"0110101101001", b"01101011010010110101101"
    if n < 3:
        return (a, b, c)[n]
    d = c + b
    for i in range(4, n):
        a, b, c, d = b, c, d, d + (c if i % 3 == 0 else a)
    return d


def uniform(length: int, seed: int = 0, min: int = 48, max: int = 57) -> bytes:
    """Seeded, so the same on each call (a seed of 0 is a seed like any other)."""
    return np.random.Generator(np.random.PCG64(seed)).integers(min, max + 1, length, np.uint8).tobytes()


def thue_morse_rows(spark: SparkSession, n: int) -> DataFrame:
    """The word as rows (i, bit), made by all tasks."""
    return spark.range(1 << max(0, n - 1)).select(F.col("id").alias("i"), (F.bit_count("id") % 2).cast("bigint").alias("bit"))


def random_rows(spark: SparkSession, length: int, seed: int = 0, low: int = 48, high: int = 57) -> DataFrame:
    return spark.range(length).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(high - low + 1)) + low).cast("bigint").alias("c"))
