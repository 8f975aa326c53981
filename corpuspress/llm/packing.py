"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is its token ids and an end mark; only one longer than a sequence is
cut.  Tokenising happens once, next to the scan: white space never takes part in
a token of this vocabulary, so ids are remembered by word in each worker and
only new words reach the tokenizer.  What is packed is a narrow table
of pieces (id, place, length, checksum).

Packing is bounded-space online best-fit: a fixed number of sequences is open,
filed by free space in a bitset; a piece goes where it leaves the least room; if
nothing has room a new sequence opens, and if too many are open the fullest
closes first.  Pieces are dealt to groups of bounded size by a hash and each
group is packed by one task, so a task's memory and time don't grow with the
corpus; each group ends with a few sequences that aren't full.

Defined cases: a null or empty text is the end mark alone; rows that repeat, or
share or lack an id, are separate documents with the same id; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A worker forgets its words beyond this number (bounded memory on endless input).
MOST_WORDS = 600_000
#: The pre-tokenizer that the short way knows; with any other every word takes the long way.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordIds(dict):
    """Word bytes to the little-endian bytes of its unsigned 32-bit ids.

    Words of plain Latin letters, digits and signs go to the merge model
    directly, where normalising is lower case alone; all others go through the
    whole tokenizer.  Both ways give the same ids.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            known = json.load(f)
        norm, pre = known.get("normalizer") or {}, (known.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.short = (
            [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": PATTERN} and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
        )
        self.plain = regex.compile(r"[\x21-\x7E\u00A1-\u012F\u0131-\u024F]+")
        self.split, self.letters = regex.compile(PATTERN), byte_letters()

    def add(self, word: bytes) -> bytes:
        """Ids of a new word; a closing sign after a letter is a token apart, so the word before it is looked up."""
        text = word.decode()
        if self.short and len(text) > 1 and text[-1] in ".,;:!?" and text[-2].isalpha():
            stem = word[:-1]
            found = (self.get(stem) or self.add(stem)) + (self.get(word[-1:]) or self.add(word[-1:]))
        else:
            found = np.array(self.ids_of(text), "<u4").tobytes()
        self[word] = found
        return found

    def ids_of(self, word: str) -> list[int]:
        if self.short and word.isascii() and word.isalpha():
            return [t.id for t in self.tokenizer.model.tokenize(word.lower())]
        if self.short and "<|" not in word and self.plain.fullmatch(word):
            merge, letters = self.tokenizer.model.tokenize, self.letters
            return [t.id for p in self.split.findall(word.lower()) for t in merge(p.encode().decode("latin-1").translate(letters))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def learn(self, texts: list[list[bytes]]) -> None:
        new = list({w for words in texts for w in words if w not in self})
        if len(self) + len(new) > MOST_WORDS:
            self.clear()
            new = list({w for words in texts for w in words})
        for word in new:
            if word not in self:
                self.add(word)

    def encode(self, column: pa.Array) -> list[bytes]:
        texts = [t.split() for t in column.cast(pa.binary()).to_pylist()]
        self.learn(texts)
        get = self.__getitem__
        return [b"".join(map(get, words)) for words in texts]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind, mark = source.schema["doc_id"].dataType.simpleString(), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        try:
            for batch in common.slices(batches, "text", 1 << 20):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(words.encode(batch.column(1))):
                    ids += mark
                    n = len(ids) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - at)
                        row.append(i), piece.append(k), start.append(at), length.append(size)
                        crc.append(zlib.crc32(ids if size == n else ids[4 * at : 4 * (at + size)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        finally:  # the words of one task hardly help the next, and an idle worker shouldn't hold them
            words.clear()
            common.give_back()

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class OpenBins:
    """Open bins filed by free space: a bitset of the free spaces in use, and the bins of each."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.bins, self.open, self.next = 0, [[] for _ in range(capacity + 1)], 0, 0

    def take(self, free: int) -> int:
        bins = self.bins[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """The bin that a piece goes to, and its offset there."""
        fits = self.bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            b = self.take(free)
        else:
            free, b = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            if self.open >= self.most:  # the fullest closes first: the least free space of all, its own included
                least = (self.bits & -self.bits).bit_length() - 1
                if left <= least:
                    return b, self.capacity - free
                self.take(least)
            self.bins[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        return b, self.capacity - free


def pack(lengths: Iterable[int], capacity: int = 2048, most_open: int = 4096) -> tuple[list[int], list[int]]:
    """Bins and offsets of pieces in order of arrival."""
    bins, ids, offsets = OpenBins(capacity, most_open), [], []
    for n in lengths:
        b, o = bins.place(n)
        ids.append(b), offsets.append(o)
    return ids, offsets


def pack_pieces(table: DataFrame, n_pieces: int, capacity: int = 2048, most_open: int = 4096, group_pieces: int = 1_000_000) -> DataFrame:
    """Add sequence_id and offset; groups hold about ``group_pieces`` pieces."""
    groups = max(1, -(-n_pieces // group_pieces))
    # Bits of the checksum join the id in the hash, so rows that share one id are dealt to all groups.
    dealt = table.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.col("length") * 31 + F.col("start")), F.lit(groups)))
    placed = dealt.repartition(groups, "__group").sortWithinPartitions("__group", "doc_id", "piece", "ids_crc32", "length")
    columns = [c for c in placed.columns if c != "__group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, None
        for batch in batches:
            found, offset = [], []
            for g, n in zip(batch.column("__group").to_pylist(), batch.column("length").to_pylist()):
                if g != group:
                    group, bins = g, OpenBins(capacity, most_open)
                b, o = bins.place(n)
                found.append((g << 36) + b), offset.append(o)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.int64()), pa.array(offset, pa.int64())], [*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return placed.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, most_open: int = 4096, group_pieces: int = 1_000_000, **columns) -> DataFrame:
    """Pack all documents; a row for each piece with its sequence and place."""
    table = common.written(pieces(docs, tokenizer_path, capacity, **columns), "pieces")
    return pack_pieces(table, table.count(), capacity, most_open, group_pieces)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(common.read(spark, sf_dir, "documents"), default_tokenizer())
