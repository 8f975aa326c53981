"""What the codecs hold in memory, as relations: factors, phrases, trie edges, grammar rules, common-prefix intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammar, lz
from .index import of, portions
from .suffixes import lcp_intervals
from .transforms import escape


def rows_of_texts(df: DataFrame, id_col: str, text_col: str, names: tuple[str, ...], make: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """The rows (of bigints) that ``make`` yields for each text that isn't null."""
    source = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__b")).where("__b IS NOT NULL")
    key = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, rows = [], []
                for i, data in enumerate(part.column(1).to_pylist()):
                    found = list(make(data))
                    owner += [i] * len(found)
                    rows += found
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], [key.name, *names])

    return source.mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names))


def factors(df: DataFrame, kind: str = "lcpcomp", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pos, src, len of each factor."""
    make = {"lzss": lz.window_factors, "lzss_lcp": lambda b: lz.lcp_factors(escape(b), 5), "lcpcomp": lambda b: lz.lcpcomp_factors(escape(b), 5)}[kind]
    return rows_of_texts(df, id_col, text_col, ("pos", "src", "len"), make)


def uncovered(factor_rows: DataFrame, sizes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """begin, end of each stretch of literals between factors (``sizes``: id and n_bytes)."""
    from pyspark.sql import Window

    ends = factor_rows.select(id_col, "pos", (F.col("pos") + F.col("len")).alias("after")).union(sizes.select(id_col, F.col("n_bytes").alias("pos"), F.col("n_bytes").alias("after")))
    before = F.coalesce(F.lag("after").over(Window.partitionBy(id_col).orderBy("pos", "after")), F.lit(0))
    return ends.select(id_col, before.alias("begin"), F.col("pos").alias("end")).where("begin < end")


def lz78_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """z, ref, c of each phrase; without the last, partial one these are the trie's edges (parent ref, byte c, child z)."""
    return rows_of_texts(df, id_col, text_col, ("z", "ref", "c"), lambda b: ((z, r, c) for z, (r, c) in enumerate(lz.lz78_factors(b), 1)))


def lzw_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return rows_of_texts(df, id_col, text_col, ("z", "code"), lambda b: enumerate(lz.lzw_codes(b)))


def lz78u_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return rows_of_texts(df, id_col, text_col, ("z", "begin", "end", "ref"), lambda b: ((z, *f) for z, f in enumerate(lz.lz78u_factors(escape(b)), 1)))


def slp_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sym, l, r of each rule of the edit-sensitive parse; the last symbol derives the text."""
    source = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__b")).where("__b IS NOT NULL")
    key = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in portions(texts):
                found = [rules for _, rules in grammar.esp_grammars(texts[part])]
                size = np.array([len(r) for r in found])
                rules = np.concatenate(found)
                number = np.arange(len(rules)) - np.repeat(np.cumsum(size) - size, size)
                columns = [batch.column(0).slice(part.start).take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(256 + number), *(pa.array(np.ascontiguousarray(c)) for c in rules.T)]
                yield pa.RecordBatch.from_arrays(columns, [key.name, "sym", "l", "r"])

    return source.mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, sym bigint, l bigint, r bigint")


def repair_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rules: int = 0) -> DataFrame:
    return rows_of_texts(df, id_col, text_col, ("sym", "l", "r"), lambda b: ((256 + i, *r) for i, r in enumerate(grammar.repair_grammar(b, max_rules)[1])))


def prefix_intervals(df: DataFrame, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """left, right (ranks) and depth of each inner node of the suffix tree that is at least ``least`` deep."""
    return rows_of_texts(df, id_col, text_col, ("left", "right", "depth"), lambda b: zip(*(v.tolist() for v in lcp_intervals(of(escape(b)).lcp, least))))


def corpus_pairs(df: DataFrame, rounds: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Most frequent byte pairs of a whole corpus, as a first step of a corpus-wide grammar: l, r, n."""
    from .profile import expanded

    found = expanded(df, [], text_col, 2)
    return found.select(F.shiftright("g", 8).alias("l"), F.col("g").bitwiseAND(255).alias("r"), "n").orderBy(F.desc("n"), "l", "r").limit(rounds)
