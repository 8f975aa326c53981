"""Token counts that follow edits: a segment tree of pre-tokens per document.

A text is cut before each space that follows a non-blank, where the pre-token
pattern of byte-level BPE always has a boundary, so token counts of the pieces
add up to the count of the text.  Pieces stand in blocks, and a segment tree
over the blocks keeps sums of characters and tokens.  An edit finds its blocks
by descending the tree, re-encodes only the pieces it touches and the one on
either side (the boundary context), and updates the sums above those blocks.

Counts of pieces are remembered in each worker; documents are independent, so
there is no shuffle.

Defined cases: a null or empty text has no tokens; null edits, or null fields of
an edit, change nothing (a null insertion is empty); positions beyond the text
are its end; edits apply in order, each to the result of the one before; rows
that repeat, or share or lack an id, are counted each on its own; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 64
MOST_PIECES = 400_000
_CUT, _MANY = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")
EDITS = "array<struct<at:bigint,cut:bigint,put:string>>"


class Counter(dict):
    """Piece to its number of tokens."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= MOST_PIECES:
            self.clear()
        n = self[piece] = len(self.coder.encode_ordinary(piece))
        return n


def pieces(text: str) -> list[str]:
    if _MANY.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]


class TokenTree:
    """Blocks of pieces under a complete binary tree of (characters, tokens)."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        parts = pieces(text) if text else []
        self.spread(parts, [counter[p] for p in parts])

    def spread(self, parts: list[str], counts: list[int]) -> None:
        """Pieces and their counts over blocks, and the sums above them."""
        self.blocks = [parts[i : i + BLOCK] for i in range(0, len(parts), BLOCK)] or [[]]
        self.counts = [counts[i : i + BLOCK] for i in range(0, len(parts), BLOCK)] or [[]]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        s = self.size
        for i, (b, c) in enumerate(zip(self.blocks, self.counts)):
            self.chars[s + i], self.tokens[s + i] = sum(map(len, b)), sum(c)
        for i in range(s - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int, int]:
        """Block and piece that hold character ``at`` (the last ones if beyond), and where the piece starts."""
        at = max(0, min(at, self.chars[1] - 1))
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        block = node - self.size
        for k, p in enumerate(self.blocks[block]):
            if at < start + len(p):
                return block, k, start
            start += len(p)
        return block, 0, start

    def edit(self, at: int, cut: int, put: str) -> int:
        """Replace ``cut`` characters at ``at``; returns how many characters were encoded again."""
        total = self.chars[1]
        at = max(0, min(at, total))
        cut = max(0, min(cut, total - at))
        if total:
            (b0, k0, start), (b1, k1, _) = self.find(at - 1), self.find(at + cut)
        else:
            b0, k0, start, b1, k1 = 0, 0, 0, 0, -1
        if b0 == b1:
            old = "".join(self.blocks[b0][k0 : k1 + 1])
        else:
            old = "".join(["".join(self.blocks[b0][k0:]), *("".join(b) for b in self.blocks[b0 + 1 : b1]), "".join(self.blocks[b1][: k1 + 1])])
        new = old[: at - start] + put + old[at - start + cut :]
        fresh = pieces(new) if new else []
        again = [self.counter[p] for p in fresh]  # nothing else is encoded
        for held, put_in in ((self.blocks, fresh), (self.counts, again)):
            if b0 == b1:
                held[b0][k0 : k1 + 1] = put_in
            else:
                held[b0][k0:] = put_in
                for b in range(b0 + 1, b1):
                    held[b] = []
                del held[b1][: k1 + 1]
        changed, s = range(b0, b1 + 1), self.size
        for b in changed:
            self.chars[s + b], self.tokens[s + b] = sum(map(len, self.blocks[b])), sum(self.counts[b])
        nodes = {(s + b) >> 1 for b in changed}
        while nodes and 0 not in nodes:
            for i in nodes:
                self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
            nodes = {i >> 1 for i in nodes}
        if len(self.blocks[b0]) > 64 * BLOCK:  # a long insertion: blocks of the usual size again, with the counts that are known
            self.spread([p for b in self.blocks for p in b], [c for b in self.counts for c in b])
        return len(new)

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_edited(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited and n_reencoded (characters), for edits ``array<struct<at,cut,put>>``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(edits_col).cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path)
        for batch in common.slices(batches, "text"):
            rows = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree = TokenTree(text, own)
                before, again = tree.tokens[1], 0
                for e in edits or ():
                    if e is not None and e["at"] is not None and e["cut"] is not None:
                        again += tree.edit(e["at"], e["cut"], e["put"] or "")
                rows.append((before, tree.tokens[1], tree.chars[1], again))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], ["doc_id", *OUT])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in OUT))


OUT = ("n_tokens", "n_tokens_edited", "n_chars_edited", "n_reencoded")


def three_edits(text_col: str = "text"):
    """A replacement at a third of the text, a copy of its beginning put in at two thirds, a heading at its start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.length(text)
    edit = lambda at, cut, put: F.struct(at.cast("bigint").alias("at"), F.lit(cut).cast("bigint").alias("cut"), put.alias("put"))
    return F.array(edit(F.floor(n / 3), 16, F.lit("edited, twice")), edit(F.floor(2 * n / 3), 0, F.substring(text, 1, 24)), edit(F.lit(0), 0, F.lit("Revised:\n")))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_edit_aware_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").withColumn("edits", three_edits())
    return count_edited(docs, default_tokenizer())
