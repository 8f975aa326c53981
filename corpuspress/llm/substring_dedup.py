"""Exact substring deduplication by a partitioned, enhanced suffix array.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere
else in the corpus.  Equal strings of that length contain the same anchor (see
``anchors``) at the same place, so the suffix array splits into independent parts
by anchor, and only texts around anchors that occur twice need to be sorted.

1. Anchors are counted; only their 64-bit hashes move.
2. For anchors found twice, the context is named by a hash: all bytes of the
   strings that contain the anchor.  Equal contexts are one leaf of the array with
   all its occurrences, which are covered as a whole.
3. Each anchor's distinct contexts are sorted as suffixes that start at the anchor,
   with the LCP array of their neighbours, and the texts before the anchor, read
   backwards, likewise.  A stack scan over the first gives the tree of
   common-prefix intervals; in each of them the same scan over the order of the
   second gives the sets that are alike to the left as far as possible.  A set that
   lies in one child of its interval isn't maximal to the right and is left out.
   What remains are the maximal repeats around the anchor, each with all its
   contexts (``repeat_groups``); the spans to cut are their union.
4. An anchor with over ``most_contexts`` distinct contexts is never gathered in one
   task.  Contexts that share a string which starts between a and b bytes before
   the anchor have the a bytes before it and the length - b bytes from it in common:
   that is the key of smaller parts, to which the same scan applies.  In a part that
   is still too large, a key of one start only is a whole string of ``length`` bytes:
   its contexts are a repeat by themselves, and counting them needs no gathering.
5. Spans are gathered by document and cut out.

Between the passes, bitsets of bounded size thin out what is shuffled; they let
through too much, never too little.  Anchors, equal contexts and the keys of parts
are told apart by 64-bit hashes (together with the anchor's own, which is another
64 bits); the scans compare bytes.

Defined cases: a null text is an empty one; texts shorter than ``length`` keep
all bytes; rows that repeat, or share or lack an id, are separate documents (the
same text twice is a repeat); a very long text is read in overlapping windows of
``WINDOW`` bytes, so memory beside the text itself doesn't grow with it; an empty
table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import anchors as anch
from . import common, suffix
from .fingerprints import mixed

LENGTH, SALTS, RANGES = 200, 128, 8
SLICE, WINDOW = 256 << 10, 1 << 20
#: Distinct contexts of an anchor that one task takes at most.
MOST_CONTEXTS = 10_000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key (of id and text), doc_id, text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    number = F.col(f"`{id_col}`").cast("bigint")
    return docs.select(F.xxhash64(number, text).alias("key"), number.alias("doc_id"), text.alias("text"))


class Found:
    """The anchors of one slice of rows, or of a window of one long text.

    ``base``: where ``data`` begins in its text; ``known``: the last anchor of the
    window before, which isn't found again; ``end``: anchors whose first string
    starts there or later are the next window's.
    """

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, length: int, base: int = 0, known: int = -1, end: int | None = None):
        self.batch, self.data, self.offsets, self.base = batch, data, offsets, base
        self.at, self.gram, first, last = anch.anchors(data, offsets, length)
        mine = np.flatnonzero((self.at + base > known) & (first < (len(data) if end is None else end)))
        self.at, self.gram = self.at[mine], self.gram[mine]
        #: Bytes from the first and the last string that has this anchor to the anchor.
        self.far, self.near = self.at - first[mine], self.at - last[mine]
        self.row = np.searchsorted(self.offsets, self.at, "right") - 1
        self.pos = self.at - self.offsets[self.row] + base
        reach = length - anch.GRAM
        self.low = np.maximum(self.at - reach, self.offsets[self.row])
        self.high = np.minimum(self.at + length, self.offsets[self.row + 1])

    def widen(self, text: np.ndarray, length: int) -> None:
        """Contexts may reach beyond the window: from here on ``data`` has what they need."""
        begin = max(0, self.base - length)
        end = min(len(text), self.base + len(self.data) + length)
        shift = self.base - begin
        self.data, self.at, self.base = text[begin:end], self.at + shift, begin
        self.offsets = np.array([0, end - begin])
        self.low, self.high = np.maximum(self.at - (length - anch.GRAM), 0), np.minimum(self.at + length, end - begin)

    def contexts(self) -> np.ndarray:
        other = anch.Rolling(self.data, 1)
        return mixed(other.of(self.low, self.high) + (self.at - self.low).astype(np.uint64)).view(np.int64)

    def take(self, keep: np.ndarray) -> list[pa.Array]:
        rows = pa.array(self.row[keep])
        return [pa.array(self.gram[keep].view(np.int64)), self.batch.column(0).take(rows), self.batch.column(1).take(rows), pa.array(self.pos[keep].astype(np.int32))]


def anchored(batches: Iterator[pa.RecordBatch], length: int, window: int = WINDOW) -> Iterator[Found]:
    """The anchors of all texts; a text of over ``window`` bytes comes in windows that overlap by a string."""
    for batch in common.slices(batches, "text", SLICE):
        data, offsets = common.text_buffer(batch.column(2))
        if len(data) <= window or batch.num_rows > 1:
            yield Found(batch, data, offsets, length)
            continue
        known = -1
        for base in range(0, len(data) - length + 1, window):
            part = data[base : base + window + 2 * length]
            found = Found(batch, part, np.array([0, len(part)]), length, base, known, window)
            if len(found.pos):
                known = int(found.pos[-1])
            found.widen(data, length)
            yield found


def bit_lookup(keys: DataFrame, column: str, most_bits: int = 1 << 28):
    """``common.hash_filter`` for numpy arrays: (bits, broadcast words) of a bigint column's mixed values."""
    n = keys.count()
    bits = min(most_bits, 1 << max(10, (16 * max(n, 1)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (mixed(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["w", "b"])

    words = keys.select(column).mapInArrow(run, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def maybe(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = mixed(values.view(np.uint64)) & np.uint64(64 * len(table) - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def place_of(key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return mixed(key.view(np.uint64) + mixed(pos.astype(np.uint64) + np.uint64(1))).view(np.int64)


def repeated_anchors(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in anchored(batches, length):
            values, times = np.unique(f.gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))], ["gram", "n"])

    counted = rows.mapInArrow(run, "gram bigint, n int").groupBy("gram").agg(F.sum("n").alias("n"))
    return common.written(counted.where("n > 1").select("gram"), "anchors")


def occurrences(rows: DataFrame, wanted, length: int) -> DataFrame:
    """gram, key, doc_id, pos, context, lo, hi of each anchor that may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in anchored(batches, length):
            keep = np.flatnonzero(maybe(wanted.value, f.gram))
            begin = f.offsets[f.row[keep]] - f.base
            yield pa.RecordBatch.from_arrays(
                [*f.take(keep), pa.array(f.contexts()[keep]), pa.array((f.low[keep] - begin).astype(np.int32)), pa.array((f.high[keep] - begin).astype(np.int32))],
                ["gram", "key", "doc_id", "pos", "context", "lo", "hi"],
            )

    return common.written(rows.mapInArrow(run, "gram bigint, key bigint, doc_id bigint, pos int, context bigint, lo int, hi int"), "occurrences")


def tallied(rows: DataFrame, *by: str) -> DataFrame:
    """Count and first (key, pos) of equal rows, with the salts under which they occur (two levels: no hot task)."""
    part = rows.groupBy(*by, "salt").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("first"))
    return common.written(part.groupBy(*by).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.collect_list("salt").alias("salts")), "tally")


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int"))


def context_rows(rows: DataFrame, places, length: int, groups: bool, hot=None, of_hot: bool = False) -> DataFrame:
    """The columns of ``CONTEXT`` for the contexts to sort, and those of ``MORE`` if sets are wanted; with ``hot``, of anchors that may be in it, or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in anchored(batches, length):
            key = f.batch.column(0).to_numpy()
            wanted = maybe(places.value, place_of(key[f.row], f.pos))
            keep = np.flatnonzero(wanted if hot is None else wanted & (maybe(hot.value, f.gram) == of_hot))
            size = f.high[keep] - f.low[keep]
            ends = np.concatenate([[0], np.cumsum(size)])
            data = f.data[np.arange(ends[-1]) - np.repeat(ends[:-1] - f.low[keep], size)]
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keep), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
            more = [pa.array(f.contexts()[keep]), *(pa.array(x[keep].astype(np.int32)) for x in (f.near, f.far))] if groups else []
            yield pa.RecordBatch.from_arrays([*f.take(keep), pa.array((f.at - f.low)[keep].astype(np.int32)), text, *more], CONTEXT + MORE * groups)

    return rows.mapInArrow(run, kinds_of(CONTEXT + MORE * groups))


#: A context: its anchor, its place, and its bytes, ``left`` of which stand before the anchor.
CONTEXT = ["gram", "key", "doc_id", "pos", "left", "bytes"]
#: Its name, and how far before the anchor strings start that have no other anchor.
MORE = ["context", "near", "far"]
KINDS = {"pos": "int", "left": "int", "bytes": "binary", "near": "int", "far": "int", "start": "int", "lo": "int", "hi": "int", "range": "int"}


def kinds_of(names: list[str]) -> str:
    return ", ".join(f"`{c}` {KINDS.get(c, 'bigint')}" for c in names)


SPAN = "key bigint, doc_id bigint, lo int, hi int"
#: A set of contexts with the bytes before and from the anchor that they share; ``repeat`` names the set.
GROUP = "repeat string, gram bigint, context bigint, before int, after int"


def sparse_order(cells: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of padded strings by group, bytes and size, and the common prefix of neighbours (-1: another group)."""
    m, width = cells.shape
    head = group.astype(">u4").view(np.uint8).reshape(m, 4)
    rows = np.ascontiguousarray(np.concatenate([head, cells], 1))
    by_size = np.argsort(size, kind="stable")
    order = by_size[np.argsort(rows[by_size].view(f"S{width + 4}").ravel(), kind="stable")]
    sorted_rows = rows[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width + 4) - 4
    lcp = np.full(m, -1, np.int64)
    lcp[1:] = np.where(first < 0, -1, np.minimum(first, np.minimum(size[order[1:]], size[order[:-1]])))
    return order, lcp


class Lowest:
    """Range minima by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of ``values[low:high]``, ranges not empty."""
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for j in np.unique(level).tolist():
            at = np.flatnonzero(level == j)
            out[at] = np.minimum(self.levels[j][low[at]], self.levels[j][high[at] - (1 << j)])
        return out


class Groups:
    """Maximal repeats around anchors: repeat g is shared by the contexts ``rows[first[g] : last[g] + 1]``,
    ``before[g]`` bytes before and ``after[g]`` bytes from their anchors."""

    def __init__(self, rows: np.ndarray, first: np.ndarray, last: np.ndarray, before: np.ndarray, after: np.ndarray):
        self.rows, self.first, self.last, self.before, self.after = rows, first, last, before, after

    def spans(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The most bytes before and from the anchor that a repeat of each of m contexts has; -1 where there is none.

        All occurrences of each repeat are marked.  Sets of one interval are nested, and the
        scan emits the inner one first: marked in the reverse order, each place keeps its own innermost.
        """
        deep, wide = np.full(len(self.rows), -1, np.int64), np.full(len(self.rows), -1, np.int64)
        for a, b, x, y in zip(self.first[::-1].tolist(), (self.last[::-1] + 1).tolist(), self.before[::-1].tolist(), self.after[::-1].tolist()):
            deep[a:b], wide[a:b] = x, y
        far, near = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
        hit = np.flatnonzero(deep >= 0)
        np.maximum.at(far, self.rows[hit], deep[hit])
        np.maximum.at(near, self.rows[hit], wide[hit])
        return far, near

    def keep(self, which: np.ndarray) -> None:
        self.first, self.last, self.before, self.after = (x[which] for x in (self.first, self.last, self.before, self.after))

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of the repeat, context) for all occurrences."""
        size = self.last - self.first + 1
        number = np.repeat(np.arange(len(size)), size)
        return number, self.rows[np.arange(len(number)) - np.repeat(np.cumsum(size) - size - self.first, size)]


def repeat_groups(data: np.ndarray, offsets: np.ndarray, left: np.ndarray, group: np.ndarray, length: int) -> Groups:
    """All maximal repeats of ``length`` bytes or more around the anchors of the same group.

    ``left``: where the anchor stands in each context.  See the module's step 3.
    """
    m, reach = len(left), length - anch.GRAM
    size = np.diff(offsets)
    row = np.repeat(np.arange(m), size)
    place = np.arange(len(data)) - (offsets[:-1] + left)[row]
    ahead, behind = np.zeros((m, length), np.uint8), np.zeros((m, max(1, reach)), np.uint8)
    right = place >= 0
    ahead[row[right], place[right]] = data[right]
    behind[row[~right], -1 - place[~right]] = data[~right]
    order_r, lcp_r = sparse_order(ahead, size - left, group)
    order_l, lcp_l = sparse_order(behind, left, group)
    rank_r, rank_l = np.empty(m, np.int64), np.empty(m, np.int64)
    rank_r[order_r], rank_l[order_l] = np.arange(m), np.arange(m)
    # The tree of common-prefix intervals of what follows the anchors.
    low, high, deep = suffix.lcp_intervals(lcp_r, length - reach)
    # A context takes part in an interval only if any other is alike enough to the left.
    beside = np.maximum(lcp_l, np.append(lcp_l[1:], -1))[rank_l]
    count = high - low + 1
    node = np.repeat(np.arange(len(low)), count)
    member = order_r[np.arange(len(node)) - np.repeat(np.cumsum(count) - count - low, count)]
    live = beside[member] >= length - deep[node]
    node, member = node[live], member[live]
    order = np.argsort(node * m + rank_l[member])
    node, member = node[order], member[order]
    none = np.zeros(0, np.int64)
    if not len(node):
        return Groups(none, none, none, none, none)
    # Sets of an interval that share what precedes them: the same scan, over how much neighbours have beyond the length still wanted.
    same = np.flatnonzero(node[1:] == node[:-1])
    lowest = Lowest(lcp_l)
    more = np.full(len(node), -1, np.int64)
    more[same + 1] = np.maximum(-1, lowest.of(rank_l[member[same]] + 1, rank_l[member[same + 1]] + 1) - (length - deep[node[same]]))
    first, last, extra = suffix.lcp_intervals(more, 0)
    after = deep[node[first]]
    before = extra + length - after
    # To the left a set of the scan can't be extended; to the right it can't if its interval is the smallest around it.
    edges = np.stack([first, last + 1], 1).ravel()
    own = np.append(rank_r[member], 0)
    a, b = (f.reduceat(own, edges)[::2] if len(first) else none for f in (np.minimum, np.maximum))
    maximal = Lowest(lcp_r).of(a + 1, b + 1) == after if len(first) else none.astype(bool)
    return Groups(member, first[maximal], last[maximal], before[maximal], after[maximal])


def scanned(contexts: DataFrame, length: int, part: list[str], groups: bool, a_time: int = 5_000) -> DataFrame:
    """Spans (or, with ``groups``, sets of contexts) of the repeats of all parts; contexts of a part meet in one task, some parts at a time.

    All repeats of a context hold its anchor, so they overlap and their union is one span.
    """
    stream = contexts.repartition(*part).sortWithinPartitions(*part)

    def solve(batch: pa.Table) -> pa.RecordBatch:
        data, offsets = common.text_buffer(batch.column("bytes"))
        keys = [batch.column(c).to_numpy() for c in part]
        new = np.zeros(len(keys[0]), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        found = repeat_groups(data, offsets, batch.column("left").to_numpy().astype(np.int64), np.cumsum(new), length)
        if groups:
            # A set is complete if one of its strings has this anchor and no other: it has it wherever it occurs.
            near, far = (batch.column(c).to_numpy().astype(np.int64) for c in ("near", "far"))
            one = found.rows[found.first] if len(found.first) else found.first
            found.keep(np.maximum(length - found.after, near[one]) <= np.minimum(found.before, far[one]))
            number, rows = found.members()
            stamp = uuid.uuid4().hex
            columns = [batch.column(c).combine_chunks().take(pa.array(rows)) for c in ("gram", "context")]
            return pa.RecordBatch.from_arrays([pa.array([f"{stamp}-{i}" for i in number.tolist()], pa.string()), *columns, pa.array(found.before[number].astype(np.int32)), pa.array(found.after[number].astype(np.int32))], ["repeat", "gram", "context", "before", "after"])
        far, near = found.spans(len(offsets) - 1)
        hit = np.flatnonzero(far >= 0)
        pos = batch.column("pos").to_numpy().astype(np.int64)[hit]
        columns = [batch.column(c).combine_chunks().take(pa.array(hit)) for c in ("key", "doc_id")]
        return pa.RecordBatch.from_arrays([*columns, pa.array((pos - far[hit]).astype(np.int32)), pa.array((pos + near[hit]).astype(np.int32))], ["key", "doc_id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, a_time):
                held.append(batch.slice(at, a_time))
                count += held[-1].num_rows
                if count < a_time:
                    continue
                table = pa.Table.from_batches(held)
                last = np.ones(len(table), bool)
                for c in part:
                    key = table.column(c).to_numpy()
                    last &= key == key[-1]
                cut = len(last) - int(last.sum())  # the last part may go on
                if cut:
                    yield solve(table.slice(0, cut))
                held, count = table.slice(cut).to_batches(), len(last) - cut
        if count:
            yield solve(pa.Table.from_batches(held))
        common.give_back()

    return stream.mapInArrow(run, GROUP if groups else SPAN)


def dealt(contexts: DataFrame, length: int, single: bool) -> DataFrame:
    """The contexts once for each range of string starts, with the key (range, part) of what contexts that share such a string have in common.

    With ``single`` the ranges are cut into their starts, and the contexts come without their bytes but with the string's place.
    """
    reach = length - anch.GRAM
    edges = np.linspace(0, reach + 1, RANGES + 1).astype(int)
    kept = [c for c in contexts.columns if c not in ("range", "part") and not (single and c in ("left", "bytes"))]
    names = [*kept, *(["start", "lo", "hi"] if single else []), "range", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "bytes", SLICE):
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            data, offsets = common.text_buffer(column("bytes"))
            one, two = anch.Rolling(data), anch.Rolling(data, 1)
            n, size = batch.num_rows, np.diff(offsets)
            left = column("left").to_numpy().astype(np.int64)
            if single:
                own = column("range").to_numpy()
                row = np.repeat(np.arange(n), edges[own + 1] - edges[own])
                near = np.concatenate([np.arange(edges[r], edges[r + 1]) for r in own.tolist()]) if n else row
                far = near
            else:
                row, near, far = np.repeat(np.arange(n), RANGES), np.tile(edges[:-1], n), np.tile(edges[1:] - 1, n)
            # ``near`` bytes before the anchor and length - ``far`` from it are what all strings of the range have in common.
            good = (left[row] >= near) & ((size - left)[row] >= length - far)
            row, near, far = row[good], near[good], far[good]
            a, b = offsets[row] + left[row] - near, offsets[row] + left[row] + length - far
            part = mixed(one.of(a, b) ^ mixed(two.of(a, b) + (near * 1009 + far).astype(np.uint64)))
            take = pa.array(row)
            out = [column(c).take(take) for c in kept]
            if single:
                pos = column("pos").to_numpy().astype(np.int64)[row]
                out += [pa.array(near.astype(np.int32)), pa.array((pos - near).astype(np.int32)), pa.array((pos - near + length).astype(np.int32)), column("range").take(take)]
            else:
                out.append(pa.array(np.searchsorted(edges, near, "right").astype(np.int32) - 1))
            yield pa.RecordBatch.from_arrays([*out, pa.array(part.view(np.int64))], names)

    return contexts.mapInArrow(run, kinds_of(names))


PART = ["gram", "range", "part"]


def split_scans(contexts: DataFrame, length: int, most_contexts: int, groups: bool) -> DataFrame:
    """``scanned`` for anchors with too many contexts, by the module's step 4."""
    parts = common.written(dealt(contexts, length, False), "parts")
    large = common.written(parts.groupBy(*PART).count().where(F.col("count") > most_contexts).select(*PART), "large")
    out = scanned(parts.join(large, PART, "anti"), length, PART, groups)
    strings = common.written(salted(dealt(parts.join(large, PART).select(*contexts.columns, "range"), length, True)), "strings")
    tally = tallied(strings, *PART).where("n > 1").select(*PART, F.explode("salts").alias("salt"))
    twice = strings.join(tally, [*PART, "salt"])
    if groups:
        name = F.concat_ws("-", F.lit("string"), *(F.col(c).cast("string") for c in PART))
        return out.union(twice.where("start BETWEEN near AND far").select(name, "gram", "context", "start", F.lit(length) - F.col("start")))
    return out.union(twice.select("key", "doc_id", "lo", "hi"))


def repeats(docs: DataFrame, length: int, id_col: str, text_col: str, most_contexts: int, groups: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences of repeated anchors, the tally of their contexts, and the spans or sets that the scans find."""
    rows = keyed(docs, id_col, text_col)
    places = salted(occurrences(rows, bit_lookup(repeated_anchors(rows, length), "gram"), length))
    tally = tallied(places, "gram", "context")
    open_ = tally.groupBy("gram").agg(F.count("*").alias("contexts"), F.sum((F.col("n") == 1).cast("int")).alias("single")).where("contexts > 1")
    # Where only spans are wanted, anchors whose contexts are all repeated are done.
    open_ = common.written(open_ if groups else open_.where("single > 0"), "groups")
    open_grams = bit_lookup(open_.select("gram"), "gram", 1 << 26)
    at = tally.select("first.key", "first.pos", "gram")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, pos, gram = (c.to_numpy() for c in batch.columns)
            keep = maybe(open_grams.value, gram)
            yield pa.RecordBatch.from_arrays([pa.array(place_of(key[keep], pos[keep]))], ["place"])
        common.give_back()

    chosen = common.written(at.mapInArrow(place, "place bigint"), "places")
    chosen = bit_lookup(chosen, "place")
    hot = open_.where(F.col("contexts") > most_contexts).select("gram")
    if hot.limit(1).count():
        many = bit_lookup(hot, "gram", 1 << 26)
        few, lots = (context_rows(rows, chosen, length, groups, many, of_hot) for of_hot in (False, True))
        return places, tally, scanned(few, length, ["gram"], groups).union(split_scans(common.written(lots, "hot"), length, most_contexts, groups))
    return places, tally, scanned(context_rows(rows, chosen, length, groups), length, ["gram"], groups)


def whole_contexts(places: DataFrame, tally: DataFrame) -> DataFrame:
    return places.join(tally.where("n > 1").select("gram", "context", F.explode("salts").alias("salt")), ["gram", "context", "salt"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """key, doc_id and the list of spans (byte offsets lo, hi) of repeated strings; documents without any are left out."""
    places, tally, spans = repeats(docs, length, id_col, text_col, most_contexts, False)
    all_spans = whole_contexts(places, tally).select("key", "doc_id", "lo", "hi").union(spans).distinct()
    return common.written(all_spans.groupBy("key", "doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")


def maximal_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """repeat, doc_id, lo, hi: the maximal repeats around each anchor, with all their occurrences (byte offsets).

    A repeat is seen from its anchors, as far as the strings of ``length`` bytes that hold the anchor
    reach: one that is longer comes in overlapping pieces, one for each of its anchors.  In parts
    that are still too large to be scanned (step 4), repeats are the strings of ``length`` bytes.
    """
    places, tally, sets = repeats(docs, length, id_col, text_col, most_contexts, True)
    sets = common.written(sets, "sets")
    salts = tally.select("gram", "context", F.explode("salts").alias("salt"))
    found = places.join(sets.join(salts, ["gram", "context"]), ["gram", "context", "salt"])
    found = found.select("repeat", "doc_id", (F.col("pos") - F.col("before")).alias("lo"), (F.col("pos") + F.col("after")).alias("hi"))
    name = F.concat_ws("-", F.lit("context"), F.col("gram").cast("string"), F.col("context").cast("string"))
    # A context found twice is a repeat of its own unless a set has all of its bytes in other contexts too.
    whole = whole_contexts(places, tally).withColumns({"before": F.col("pos") - F.col("lo"), "after": F.col("hi") - F.col("pos")})
    return found.union(whole.join(sets.select("gram", "context", "before", "after").distinct(), ["gram", "context", "before", "after"], "anti").select(name, "doc_id", "lo", "hi"))


def repeat_sizes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """repeat, n_bytes, n_occurrences, first (doc_id, lo) of each repeat that ``maximal_repeats`` lists.

    Occurrences are counted by context before sets are looked at: a set has a row for each of its contexts, not for each place.
    """
    places, tally, sets = repeats(docs, length, id_col, text_col, most_contexts, True)
    sets = common.written(sets, "sets")
    own = places.groupBy("gram", "context", (F.col("pos") - F.col("lo")).alias("before"), (F.col("hi") - F.col("pos")).alias("after"))
    counted = common.written(own.agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")), "counted")

    def summed(rows: DataFrame, *by: str) -> DataFrame:
        start = F.struct(F.col("first.doc_id").alias("doc_id"), (F.col("first.pos") - F.col("before")).alias("lo"))
        return rows.withColumn("first", start).groupBy(*by).agg(F.max(F.col("before") + F.col("after")).cast("bigint").alias("n_bytes"), F.sum("n").alias("n_occurrences"), F.min("first").alias("first"))

    found = summed(sets.join(counted.select("gram", "context", "n", "first"), ["gram", "context"]), "repeat")
    # As in maximal_repeats: a context found twice is a repeat of its own unless a set has all of its bytes.
    twice = counted.join(tally.where("n > 1").select("gram", "context"), ["gram", "context"])
    whole = summed(twice.join(sets.select("gram", "context", "before", "after").distinct(), ["gram", "context", "before", "after"], "anti"), "gram", "context")
    name = F.concat_ws("-", F.lit("context"), F.col("gram").cast("string"), F.col("context").cast("string"))
    return found.union(whole.select(name, "n_bytes", "n_occurrences", "first"))


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """The rows of ``docs`` that may have spans, with two more columns, text and spans (null where there are none), the other rows with the first of them, and its name; only the former are shuffled."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    number = F.col(f"`{id_col}`").cast("bigint")
    t, key, i, k, n, s = common.free(docs.columns, "text", "key", "id", "k", "n", "spans")
    rows = docs.withColumns({t: text, key: F.xxhash64(number, text), i: number})
    likely = common.hash_filter(spans.select("key"), "key")
    some = rows.where(likely(F.col(key))).join(spans.toDF(k, n, s), (F.col(key) == F.col(k)) & F.col(i).eqNullSafe(F.col(n)), "left")
    names = [*(F.col(f"`{c}`") for c in docs.columns), F.col(t)]
    return some.select(*names, F.col(s)), rows.where(~likely(F.col(key))).select(*names), t


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for lo, hi in runs:
        parts.append(data[at:lo])
        at = hi
    return b"".join([*parts, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows, rest, name = with_spans(source, repeated_spans(source, length, "doc_id", "text", most_contexts), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, name):
            out = []
            for data, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                runs = merged(spans or [])
                out.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()))
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(next(columns), pa.int64()) for _ in range(3)), pa.array(next(columns))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = source.schema["doc_id"].dataType.simpleString()
    found, none = rows.drop("text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"), F.lit(0).cast("bigint")
    whole = F.col(name).cast("binary")
    return found.union(rest.select("doc_id", F.length(whole).cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256")))


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeats cut out of the texts (and ``chars_col`` set anew where there is one).

    Bytes left of a cut character are dropped; a text that loses all its words
    goes, one that had none stays.  Nulls, empty texts and other columns stay as
    they are, whatever the columns' names; repeated rows lose their text and go.
    """
    rows, rest, name = with_spans(docs, repeated_spans(docs, length, id_col, text_col), id_col, text_col)
    at, size = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, name):
            hit = [i for i, s in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if s]
            columns = batch.columns[:-2]
            if hit:
                texts, keep = columns[at].to_pylist(), np.ones(batch.num_rows, bool)
                sizes = columns[size].to_pylist() if size >= 0 else None
                spans = batch.column(batch.num_columns - 1)
                for i in hit:
                    texts[i] = kept_bytes(texts[i].encode(), merged(spans[i].as_py())).decode("utf-8", "ignore")
                    keep[i] = bool(texts[i].encode().split())
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                columns[at] = pa.array(texts, columns[at].type)
                if sizes is not None:
                    columns[size] = pa.array(sizes, columns[size].type)
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2]).filter(pa.array(keep))
            else:
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2])
            yield batch

    return rows.mapInArrow(run, docs.schema).union(rest.drop(name))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read(spark, sf_dir, "documents"))


def maximal_repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each maximal repeat of op8 over ``documents``: its length, how often it is there, and its first place."""
    rows = repeat_sizes(common.read(spark, sf_dir, "documents"))
    return rows.select("n_bytes", "n_occurrences", F.col("first.doc_id").alias("doc_id"), F.col("first.lo").cast("bigint").alias("start"))


#: The same by all windows of 200 bytes.
OP8_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, i, md5(b[i + 1:i + 200]) AS m FROM (SELECT rid, b, unnest(range(0, CAST(octet_length(b) - 199 AS BIGINT))) AS i FROM d WHERE octet_length(b) >= 200)),
c AS (SELECT rid, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
g AS (SELECT rid, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM c)),
r AS (SELECT rid, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY rid, run),
p AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS last FROM r),
s AS (SELECT rid, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS finish, string_agg(CASE WHEN lo > last THEN hex(b[last + 1:lo]) ELSE '' END, '' ORDER BY lo) AS kept FROM p JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN kept IS NULL THEN b WHEN finish < octet_length(b) THEN unhex(kept || hex(b[finish + 1:octet_length(b)])) ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN s USING (rid)
"""
