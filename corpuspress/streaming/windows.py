"""Streaming extension: compression of event windows and of keyed streams with a bounded dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import compress


def windowed(df: DataFrame, time_col: str, key_col: str, text_col: str, width: str = "1 hour", late: str | None = None, algorithm: str = "lzw(coder=bit)") -> DataFrame:
    """Tumbling windows: events, raw bytes, and the window's texts in time order as one compressed blob.

    Works on tables and on streams (give ``late``, the watermark).
    """
    if late:
        df = df.withWatermark(time_col, late)
    own = F.window(time_col, width)
    out = df.groupBy(own.alias("w"), F.col(key_col)).agg(F.count("*").alias("n_events"), F.sum(F.octet_length(text_col)).cast("bigint").alias("raw_bytes"), F.sort_array(F.collect_list(F.struct(time_col, text_col))).alias("events"))
    joined: Column = F.array_join(F.transform("events", lambda e: e[text_col]), "\n")
    return out.select(F.col("w.start").alias("window_start"), key_col, "n_events", "raw_bytes", compress(joined, algorithm).alias("blob"))


def keyed_lzw(df: DataFrame, key_col: str, text_col: str, dict_size: int = 4096) -> DataFrame:
    """A stream of texts by key: codes emitted so far under a dictionary that lives in the state.

    The dictionary starts anew when it holds ``dict_size`` phrases, so state is bounded.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        trie_rows, n_codes, n_bytes, node = state.get if state.exists else ([], 0, 0, -1)
        trie = {(int(a), int(b)): i + 256 for i, (a, b) in enumerate(zip(trie_rows[::2], trie_rows[1::2]))}
        for frame in frames:
            for text in frame[text_col].dropna():
                for c in text.encode():
                    n_bytes += 1
                    child = c if node < 0 else trie.get((node, c))
                    if child is None:
                        n_codes += 1
                        if len(trie) >= dict_size:
                            trie = {}
                        trie[node, c] = 256 + len(trie)
                        child = c
                    node = child
        state.update(([x for pair in trie for x in pair], n_codes, n_bytes, node))
        yield pd.DataFrame({key_col: [key[0]], "n_bytes": [n_bytes], "n_codes": [n_codes + (node >= 0)]})

    kind = df.schema[key_col].dataType.simpleString()
    return df.groupBy(key_col).applyInPandasWithState(step, f"{key_col} {kind}, n_bytes bigint, n_codes bigint", "trie array<bigint>, n_codes bigint, n_bytes bigint, node bigint", "update", "NoTimeout")
