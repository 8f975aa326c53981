"""Text indexes: suffix array and what derives from it, as arrays of one text or as a relation.

The relation has a row for each suffix; texts are indexed with a closing zero
(and zeros inside them escaped), many texts of an Arrow batch in one sort.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffixes import neighbour_lcp, packed, sort_suffixes
from .transforms import escape

#: What each index needs first; only what is asked for is computed.
NEEDS = {
    "sa": (), "isa": ("sa",), "phi": ("sa",), "lcp": ("sa",), "plcp": ("lcp",), "psi": ("isa",), "bwt": ("sa",), "lf": ("bwt",), "first": ("sa",),
    "lpf": ("lcp", "isa"), "lyndon": ("isa",), "sl": ("isa",),
}


def closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        if name not in NEEDS:
            raise ValueError(f"no index is called {name}")
        for other in NEEDS[name]:
            add(other)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


class Index:
    """Indexes of a concatenation of texts; positions and ranks count within each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n, size = len(data), np.diff(offsets)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.base = offsets[:-1][self.doc]
        self.end = offsets[1:][self.doc]
        self.found: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in NEEDS:
            raise AttributeError(name)
        if name not in self.found:
            self.found[name] = getattr(self, "_" + name)()
        return self.found[name]

    def _sa(self) -> np.ndarray:
        if not self.n:
            self.levels = []
            return np.zeros(0, np.int64)
        symbols, self.span = packed(self.data, self.doc, self.end)
        sa, self.levels = sort_suffixes(symbols, self.doc, span=self.span)
        return sa

    def _isa(self) -> np.ndarray:
        isa = np.empty(self.n, np.int64)
        isa[self.sa] = np.arange(self.n)
        return isa

    def _lcp(self) -> np.ndarray:
        sa = self.sa
        if self.n < 2:
            return np.zeros(self.n, np.int64)
        lcp = neighbour_lcp(sa, self.levels, self.end, self.data)
        # Neighbours that differ within the first packed symbol.
        first = self.levels[0][1]
        live = np.flatnonzero(first[sa[1:]] != first[sa[:-1]]) + 1
        a, b = sa[live - 1], sa[live]
        live = live[self.doc[a] == self.doc[b]]
        for k in range(self.span - 1):
            a, b = sa[live - 1] + k, sa[live] + k
            inside = np.maximum(a, b) < self.n
            live, a, b = live[inside], a[inside], b[inside]
            base = self.end[sa[live]]
            live = live[(a < base) & (b < base) & (self.data[a] == self.data[b])]
            lcp[live] += 1
        return lcp

    def _phi(self) -> np.ndarray:
        phi = np.empty(self.n, np.int64)
        before = np.roll(self.sa, 1)
        firsts = self.offsets[:-1][np.diff(self.offsets) > 0]
        lasts = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        before[firsts] = self.sa[lasts]
        phi[self.sa] = before
        return phi

    def _plcp(self) -> np.ndarray:
        plcp = np.empty(self.n, np.int64)
        plcp[self.sa] = self.lcp
        return plcp

    def _psi(self) -> np.ndarray:
        after = self.sa + 1
        after = np.where(after == self.end[self.sa] if self.n else after, self.base[self.sa], after) if self.n else after
        return self.isa[after] if self.n else after

    def _bwt(self) -> np.ndarray:
        before = np.where(self.sa == self.base[self.sa], self.end[self.sa], self.sa) - 1 if self.n else self.sa
        return self.data[before] if self.n else self.data

    def _first(self) -> np.ndarray:
        return self.data[self.sa]

    def _lf(self) -> np.ndarray:
        order = np.lexsort((self.bwt, self.doc))
        lf = np.empty(self.n, np.int64)
        lf[order] = np.arange(self.n)
        return lf

    def _lpf(self) -> np.ndarray:
        """Longest earlier factor of each position: the larger common prefix with the nearest smaller position on either side."""
        return np.maximum(*(x[1] for x in neighbours(self.sa, self.lcp)))

    def _lyndon(self) -> np.ndarray:
        """Whether a Lyndon factor starts here: the rank is a new minimum of its text."""
        isa = self.isa
        big = isa - self.base + (self.doc.max() - self.doc if self.n else 0) * (self.n + 1)
        low = np.minimum.accumulate(big) if self.n else big
        return np.append(True, big[1:] < low[:-1]) if self.n else np.zeros(0, bool)

    def _sl(self) -> np.ndarray:
        """Type S: the suffix is smaller than the next one of its text; the last is S."""
        nxt = np.append(self.isa[1:], self.n)
        last = np.arange(self.n) == self.end - 1
        return last | (self.isa < nxt)


def neighbours(sa: np.ndarray, lcp: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For each text position: source and common prefix with the previous and the next smaller position in suffix order."""
    out = []
    for order, prefix in ((sa, lcp), (sa[::-1], np.append(lcp[1:], 0)[::-1])):
        # Links to the neighbour before, with the least prefix on the way, jump over all that is larger.
        link, least, live = np.arange(len(sa)) - 1, prefix.copy(), np.arange(1, len(sa))
        while len(live):
            at = link[live]
            live = live[(at >= 0) & (order[at] > order[live])]
            at = link[live]
            least[live], link[live] = np.minimum(least[live], least[at]), link[at]
        source, length = np.full(len(sa), -1, np.int64), np.zeros(len(sa), np.int64)
        good = np.flatnonzero((link >= 0) & (least > 0))
        source[order[good]], length[order[good]] = order[link[good]], least[good]
        out.append((source, length))
    return out[0], out[1]


def of(data: bytes) -> Index:
    """The index of one text that has its closing zero."""
    a = np.frombuffer(data, np.uint8)
    return Index(a, np.array([0, len(a)], np.int64))


def portions(texts: Sequence, most: int = 1 << 20) -> Iterator[slice]:
    """Slices of texts (or nulls) of at most ``most`` bytes, but of one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > at and size + n > most:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))


def indexed(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, Index]]:
    """Indexes of as many texts at once as stay below ``most`` bytes, each with the number of its first text."""
    texts, at = [escape(t) for t in texts], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        yield at, Index(np.frombuffer(b"".join(part), np.uint8), offsets)
        at = end


def text_index(df: DataFrame, names: tuple[str, ...] = ("sa",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each suffix of each text: id, i and the indexes asked for.

    ``i`` is a rank for sa, lcp, psi, lf, bwt and first, and a position for isa,
    phi, plcp, lpf, lyndon and sl.  Null texts have no rows.
    """
    closure(names)
    source = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__b")).where("__b IS NOT NULL")
    key = source.schema[0]
    kinds = {"lyndon": "boolean", "sl": "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in indexed(batch.column(1).to_pylist()):
                columns = [batch.column(0).take(pa.array(x.doc + at)), pa.array(np.arange(x.n) - x.base)]
                for name in names:
                    v = getattr(x, name)
                    if name in kinds:
                        columns.append(pa.array(v))
                    elif name in ("lcp", "plcp", "lpf", "bwt", "first"):
                        columns.append(pa.array(v.astype(np.int64)))
                    else:
                        columns.append(pa.array(v - x.base))
                yield pa.RecordBatch.from_arrays(columns, [key.name, "i", *names])

    schema = f"`{key.name}` {key.dataType.simpleString()}, i bigint, " + ", ".join(f"{n} {kinds.get(n, 'bigint')}" for n in names)
    return source.mapInArrow(run, schema)


def bwt_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Number of equal-letter runs of each text's transform, and its maximal and average common prefix."""
    source = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__b")).where("__b IS NOT NULL")
    key = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in indexed(batch.column(1).to_pylist()):
                first = x.offsets[:-1]
                change = np.append(True, x.bwt[1:] != x.bwt[:-1])
                change[first] = True
                runs, most, total = np.add.reduceat(change.astype(np.int64), first), np.maximum.reduceat(x.lcp, first), np.add.reduceat(x.lcp, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(first)), pa.array(runs), pa.array(most), pa.array(total / np.diff(x.offsets))], [key.name, "bwt_runs", "max_lcp", "avg_lcp"])

    return source.mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, bwt_runs bigint, max_lcp bigint, avg_lcp double")


def rank_bits(df: DataFrame, group: list[str], order: list[str], bit) -> DataFrame:
    """rank1 and rank0 (inclusive) of each position of a bit sequence held as rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("rank1", F.sum(bit.cast("bigint")).over(w)).withColumn("rank0", F.sum((1 - bit.cast("int")).cast("bigint")).over(w))


def select_bits(df: DataFrame, group: list[str], order: list[str], bit) -> DataFrame:
    """Position of the k-th set bit: one row for each set bit."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*order)
    placed = df.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).where(bit.cast("int") == 1)
    return placed.withColumn("k", F.row_number().over(w).cast("bigint"))
