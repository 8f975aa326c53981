"""MinHash near-deduplication with HyperMinHash registers, confirmed on full sets.

1. One Arrow pass gives each text its set of word shingles, the size and a
   128-bit name of the set, and 128 compressed registers.
2. Equal sets are one node with a number of its own (two-level aggregation, so a
   set that a third of all rows share is spread over salts).  Ids never name a
   node: rows that share an id are judged by their own texts.
3. Bands of four registers are bucket keys.  Each bucket links its members to one of
   them: candidate pairs grow with the members, not with their square.  The centre is
   the member that meets most others over all its buckets: of versions of one text
   that is the one least changed, and a version that is within the threshold of any
   other is most often within the threshold of it.
4. Candidates of every size pass a size bound (exact) and the collision-corrected
   estimate (``hyperminhash.surely_below``: a chance of 1e-9, by the registers
   that the two sets filled), and are confirmed on full sets: a centre's text
   meets its members' texts in a sorted stream, hot centres are split by salts.
5. Confirmed links give components (labels and pointer jumping).
6. Buckets that still hold several components aren't expanded into pairs.  Their
   nodes are joined on the rarest shingles of their sets instead: two sets at the
   threshold have one in common among the first (1 - 0.8) of the one and the
   first (1 - 2 * 0.8 / 1.8) of the other, in any common order of the shingles
   (prefix filter; exact).  So members of a hot bucket that share only what all
   of them share don't meet.  Shingles that many nodes have are split by parts.
   The order comes from hashed counts of a fixed number of counters, which has an
   influence on the work, never on the result.  Of the pairs that meet, those stay
   whose shingles up to the last that met, with all that follows it, can be enough,
   and whose bitmaps of all shingles don't differ in too many bits (both exact).

At the threshold 0.8 two texts share no bucket with probability 5e-8; everything
else is exact up to 64-bit hashes of shingles and the chance in 4.  Joins whose
one side repeats a key (a hub's links, a hot label) end in a write or in an
aggregate by another key, so adaptive execution splits their partitions.

Defined cases: a text without words (null, empty, blank) has the empty set, links
with nothing and is its own component; rows with a null id take part like others
and belong to a component named by its smallest id, null only if all its rows
lack one; rows that repeat an id are judged by their own texts; a very long text
is one row of one batch (some 60 bytes of memory a byte); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import hyperminhash as hmh
from .substring_dedup import bit_lookup, maybe

SALTS = 64
#: Hashed counters that order shingles by how common they are.
COUNTERS = 1 << 20
#: Bits that a set is compared by before its text is fetched.
BITS = 1 << 12
NODE = ["k1", "k2", "n"]
#: Names a row: 128 bits made of its id and text.
ROW = ["key", "key2"]


def row_names(id_col: str, text_col: str) -> list[Column]:
    """Two independent 64-bit hashes of id and text; nulls differ from zeros and empty texts."""
    i, t = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").cast("string")
    return [F.xxhash64(i.isNull(), i, t.isNull(), t), F.xxhash64(t, t.isNull(), i, i.isNull(), F.length(t))]


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, k1, k2, regs, key, key2 and salt for each row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"), *(c.alias(n) for c, n in zip(row_names(id_col, text_col), ROW)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in common.slices(batches, "text", 512 << 10):
            first, h = hmh.shingle_sets(batch.column(1))
            k1, k2 = hmh.set_keys(first, h)
            regs = hmh.packed(first, h)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(hmh.WIDTH), len(regs), [None, pa.py_buffer(regs.tobytes())])
            salt = pa.array(((done + np.arange(len(regs))) % SALTS).astype(np.int32))
            done += len(regs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(k1), pa.array(k2), raw.cast(pa.binary()), batch.column(2), batch.column(3), salt], ["doc_id", "n", "k1", "k2", "regs", "key", "key2", "salt"])

    return source.mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, regs binary, key bigint, key2 bigint, salt int")


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row for each non-empty set: node (its number), k1, k2, n, rep (smallest id), regs, rows, salts, and key, key2 of one of its rows."""
    part = rows.where("n > 0").groupBy(*NODE, "salt").agg(F.min("doc_id").alias("rep"), F.first(F.struct("regs", *ROW)).alias("one"), F.count("*").alias("rows"))
    whole = part.groupBy(*NODE).agg(F.min("rep").alias("rep"), F.first("one").alias("one"), F.sum("rows").alias("rows"), F.collect_list("salt").alias("salts"))
    # Numbers count within the files that are written here, so they never change.
    return common.written(whole.select(F.monotonically_increasing_id().alias("node"), *NODE, "rep", "one.*", "rows", "salts"), "nodes")


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """(bucket, node, salt, m) of the buckets that two nodes or more share, m of them."""

    def keyed(likely=None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 8192):
                    part = batch.slice(at, 8192)
                    data, _ = common.text_buffer(part.column(1))
                    keys = hmh.band_keys(hmh.unpacked(data)[0]).ravel()
                    again = np.repeat(np.arange(part.num_rows), hmh.BANDS)
                    if likely is not None:
                        keep = maybe(likely.value, keys)
                        keys, again = keys[keep], again[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(pa.array(again))], ["bucket", "node"])
            common.give_back()

        return nodes.select("node", "regs").mapInArrow(run, "bucket bigint, node bigint").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))

    part = keyed().groupBy("bucket", "salt").agg(F.count("*").alias("m"))
    whole = part.groupBy("bucket").agg(F.sum("m").alias("m"), F.collect_list("salt").alias("salts")).where("m > 1")
    shared = common.written(whole, "buckets")
    found = keyed(bit_lookup(shared.select("bucket"), "bucket", 1 << 26)).join(shared.select("bucket", "m", F.explode("salts").alias("salt")), ["bucket", "salt"])
    return common.written(found, "members")


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket whose centre is b; which member that is has an influence on the work, never on the result."""
    met = members.groupBy("node").agg(F.sum("m").alias("met"))
    part = members.join(met, "node").groupBy("bucket", "salt").agg(F.max(F.struct("met", "node")).alias("top"))
    whole = part.groupBy("bucket").agg(F.max("top").alias("top"), F.collect_list("salt").alias("salts"))
    centres = common.written(whole.select("bucket", F.col("top.node").alias("centre"), F.explode("salts").alias("salt")), "centres")
    pairs = members.join(centres, ["bucket", "salt"]).where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    return common.written(pairs.distinct(), "star")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that may reach the threshold."""

    @F.arrow_udf(T.BooleanType())
    def likely(a: pa.Array, b: pa.Array) -> pa.Array:
        similarity, cells = hmh.estimate(*(hmh.unpacked(common.text_buffer(c)[0]) for c in (a, b)))
        return pa.array(~hmh.surely_below(similarity, cells, percent / 100))

    own = nodes.select("node", "n", "regs")
    both = pairs.join(own.toDF("a", "na", "ra"), "a").join(own.toDF("b", "nb", "rb"), "b")
    return both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where(likely("ra", "rb")).select("a", "b")


def texts_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``wanted`` but the names of rows, with the text of the row named; one row for each node."""
    likely = common.hash_filter(wanted.select("key"), "key")
    source = docs.select(*(c.alias(n) for c, n in zip(row_names(id_col, text_col), ROW)), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = source.where(likely(F.col("key"))).join(wanted, ROW).drop(*ROW)
    # Rows that repeat both id and text come several times: they are one before they are shuffled.
    rest = [c for c in found.columns if c not in ("node", "text")]
    return common.written(found.groupBy("node", *rest).agg(F.first("text").alias("text")), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold; b is the side whose text is shared."""
    fan = pairs.groupBy("b").agg((F.floor(F.count("*") / 256) + 1).alias("fan"))
    dealt = pairs.join(fan, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("fan"))).select("a", "b", "part")
    members = dealt.join(texts.select(F.col("node").alias("a"), "text"), "a").select("b", "part", F.lit(1).alias("kind"), "a", "text")
    centres = dealt.select("b", "part").distinct().join(texts.select(F.col("node").alias("b"), "text"), "b").select("b", "part", F.lit(0).alias("kind"), F.col("b").alias("a"), "text")
    stream = members.union(centres)
    stream = stream.repartition(F.col("b"), F.col("part")).sortWithinPartitions("b", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in common.slices(batches, "text", 512 << 10):
            first, h = hmh.shingle_sets(batch.column(4))
            b, part, kind, a = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i in range(batch.num_rows):
                own = h[first[i] : first[i + 1]]
                if kind[i] == 0:
                    at, centre = (b[i], part[i]), own.copy()
                elif at == (b[i], part[i]):
                    place = np.searchsorted(centre, own)
                    place[place == len(centre)] = 0
                    both = int((centre[place] == own).sum())
                    if 100 * both >= percent * (len(own) + len(centre) - both):
                        out.append((a[i], b[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return common.written(stream.mapInArrow(run, "a bigint, b bigint").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(v, label): the smallest node that each linked node reaches."""
    edges = common.written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u <> v").distinct(), "edges")
    label = common.written(edges.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")), "labels")
    while True:
        near = edges.join(label.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        low = label.join(near, "v").select("v", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = common.written(low, "lows")
        ends = jump.select(F.col("v").alias("low"), F.col("low").alias("end"))
        new = common.written(jump.join(ends, "low").select("v", F.least("low", "end").alias("label"), "old"), "labels")
        if new.where("label <> old").limit(1).count() == 0:
            return new.select("v", "label")
        label = new.select("v", "label")


def unsettled(members: DataFrame, label: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, comp, key, key2 of the nodes in buckets that hold several components."""
    named = members.join(label.withColumnRenamed("v", "node"), "node", "left").select("bucket", "salt", "node", F.coalesce("label", "node").alias("comp"))
    part = named.groupBy("bucket", "salt").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    whole = part.groupBy("bucket").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("salt").alias("salts")).where("low < high")
    mixed = common.written(whole.select("bucket", F.explode("salts").alias("salt")), "mixed")
    some = members.join(mixed, ["bucket", "salt"], "semi").select("node").distinct()
    found = nodes.select("node", "n", *ROW).join(some, "node").join(label.withColumnRenamed("v", "node"), "node", "left")
    return common.written(found.select("node", "n", F.coalesce("label", "node").alias("comp"), *ROW), "unsettled")


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefix_rows(texts: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, n, comp, place, narrow) of the rarest shingles of each set, as many as the prefix filter needs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in common.slices(batches, "text", 512 << 10):
            total += np.bincount(slot(hmh.shingle_sets(batch.column(0))[1]), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "times"])

    # At most COUNTERS rows, whatever the corpus.
    counted = texts.select("text").mapInArrow(count, "slot bigint, times bigint").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(COUNTERS, np.int64)
    times[counted.column("slot").to_numpy()] = counted.column("times").to_numpy()
    # Ranks on a scale of logarithms fit a byte.
    common_as = texts.sparkSession.sparkContext.broadcast(np.minimum(255, np.log2(times + 1.0) * 6).astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 512 << 10):
            first, h = hmh.shingle_sets(batch.column(3))
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, common_as.value[slot(h)], row))
            place = np.arange(len(h)) - first[row]
            wide = n + (-percent * n) // 100 + 1
            narrow = n + (-2 * percent * n) // (100 + percent) + 1
            keep = place < wide[row]
            take, at = pa.array(row[keep]), place[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h[order][keep].view(np.int64)), *(batch.column(i).take(take) for i in range(3)), pa.array(at), pa.array(at < narrow[row[keep]])], ["shingle", "node", "n", "comp", "place", "narrow"])

    rows = texts.select("node", "n", "comp", "text").mapInArrow(run, "shingle bigint, node bigint, n bigint, comp bigint, place bigint, narrow boolean")
    return common.written(rows, "prefixes")


def prefix_pairs(rows: DataFrame, percent: int, a_part: int = 1024) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may reach the threshold by their rarest shingles."""
    shared = rows.groupBy("shingle").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("narrow").alias("any")).where("low < high AND any")
    shared = common.written(shared.select("shingle", (F.floor(F.col("m") / a_part) + 1).alias("fan")), "shared")
    likely = common.hash_filter(shared.select("shingle"), "shingle")
    found = common.written(rows.where(likely(F.col("shingle"))).join(shared, "shingle"), "meeting")
    # The smaller set looks with its shorter prefix; its side is dealt to parts, the other's is there in each.
    small = found.where("narrow").select("shingle", F.pmod(F.xxhash64("node"), F.col("fan")).alias("part"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), F.col("place").alias("px"))
    large = found.select("shingle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("fan") - 1)).alias("part"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), F.col("place").alias("py"))
    # What two sets share is at most what stands before the shingle in both, itself, and what follows it in both.
    rest = F.least(F.col("nx") - F.col("px") - 1, F.col("ny") - F.col("py") - 1)
    most = F.least("px", "py") + 1 + rest
    pairs = small.join(large, ["shingle", "part"]).where((F.col("cx") != F.col("cy")) & (F.col("nx") <= F.col("ny")) & (100 * F.col("nx") >= percent * F.col("ny")))
    pairs = pairs.where((100 + percent) * most >= percent * (F.col("nx") + F.col("ny")))
    # All shingles that both have up to the last that met have met: with what follows it in both, that is the most they share.
    pairs = pairs.groupBy("x", "nx", "y", "ny").agg(F.count("*").alias("met"), F.max("px").alias("px"), F.max("py").alias("py"))
    pairs = pairs.where((100 + percent) * (F.col("met") + rest) >= percent * (F.col("nx") + F.col("ny")))
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def overlapping(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sets may share enough, by a bit for each shingle: a bit that only one side has is a shingle that the other lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 512 << 10):
            first, h = hmh.shingle_sets(batch.column(1))
            bits = np.zeros(batch.num_rows * BITS, bool)
            bits[np.repeat(np.arange(batch.num_rows), np.diff(first)) * BITS + (h & np.uint64(BITS - 1)).astype(np.int64)] = True
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), batch.num_rows, [None, pa.py_buffer(np.packbits(bits).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), raw.cast(pa.binary())], ["node", "n", "bits"])

    @F.arrow_udf(T.BooleanType())
    def enough(na: pa.Array, nb: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        na, nb = na.to_numpy(), nb.to_numpy()
        a, b = (np.frombuffer(common.text_buffer(c)[0].tobytes(), np.uint64).reshape(-1, BITS // 64) for c in (a, b))
        most = np.minimum(na - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
        return pa.array((100 + percent) * most >= percent * (na + nb))

    own = common.written(texts.select("node", "text").mapInArrow(run, "node bigint, n bigint, bits binary"), "bits")
    both = pairs.join(own.toDF("a", "na", "ba"), "a").join(own.toDF("b", "nb", "bb"), "b")
    return common.written(both.where(enough("na", "nb", "ba", "bb")).select("a", "b"), "enough")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row, and k1, k2 (its set), key, key2 (its id and text)."""
    rows = common.written(signed(docs, id_col, text_col), "signed")
    nodes = nodes_of(rows)
    members = bucket_rows(nodes)
    star = star_pairs(members)
    pairs = common.written(plausible(star, nodes, percent), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = common.written(nodes.select("node", *ROW).join(ends, "node"), "wanted")
    links = confirmed(pairs, texts_of(wanted, docs, id_col, text_col), percent)
    label = components(links)
    texts = texts_of(unsettled(members, label, nodes), docs, id_col, text_col)
    fresh = prefix_pairs(prefix_rows(texts, percent), percent).join(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "anti")
    more = confirmed(common.written(plausible(overlapping(fresh, texts, percent), nodes, percent), "pairs"), texts, percent)
    if more.limit(1).count():
        label = components(links.union(more))
    # A component is named by its smallest id, whichever of its nodes has it.
    linked = common.written(label.join(nodes.select(F.col("node").alias("v"), "rep"), "v"), "linked")
    named = linked.groupBy("label").agg(F.min("rep").alias("least"))
    found = nodes.join(linked.join(named, "label").select(F.col("v").alias("node"), F.lit(True).alias("in_links"), "least"), "node", "left").where("rows > 1 OR in_links")
    found = common.written(found.select(*NODE, F.explode("salts").alias("salt"), F.when(F.col("in_links"), F.col("least")).otherwise(F.col("rep")).alias("least"), F.lit(True).alias("grouped")), "found")
    joined = rows.drop("regs").join(found, [*NODE, "salt"], "left")
    component = F.when(F.col("grouped"), F.col("least")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "k1", "k2", *ROW)


def without_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns; texts without words are no copies and all stay.

    The row is one with the component's id; of several such rows (repeated ids)
    that with the smallest hash of id and text stays, of rows equal in these the
    smallest by a hash of all columns.  A component without any id keeps one row
    by the same rule.  Input columns may have any names.
    """
    verdict = common.written(near_duplicates(docs, percent, id_col, text_col).select(F.col("n_shingles").alias("n"), "component_id", "kept", "k1", "k2", *ROW), "verdict")
    mine = verdict.where("kept AND n > 0").withColumns({k: F.when(F.col("component_id").isNull(), F.col(k)) for k in ("k1", "k2")})
    group = ["component_id", "k1", "k2"]
    several = mine.groupBy(*group).agg(F.count("*").alias("rows"), F.min(F.struct(*ROW)).alias("stays")).where("rows > 1")
    several = common.written(several.drop("rows"), "several")
    same = [mine[c].eqNullSafe(several[c]) for c in group]
    losers = mine.join(several, same[0] & same[1] & same[2]).where(F.struct(mine["key"], mine["key2"]) != F.col("stays")).select(mine["key"], mine["key2"])
    drop = common.written(verdict.where(~F.col("kept")).select(*ROW).union(losers).distinct(), "dropped")
    twice = several.select("stays.*")
    gone, again = common.hash_filter(drop.select("key"), "key"), common.hash_filter(twice.select("key"), "key")
    one, two, row = common.free(docs.columns, *ROW, "row")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumns(dict(zip((one, two), row_names(id_col, text_col))))
    # Only rows that may go are shuffled.
    suspect = gone(F.col(one)) | again(F.col(one))
    left = rows.where(suspect).join(drop.toDF(one, two), [one, two], "anti")
    marked = left.join(twice.select(F.col("key").alias(one), F.col("key2").alias(two), F.lit(True).alias(row)), [one, two], "left")
    once = marked.where(F.col(row)).groupBy(one, two).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias(row)).select(f"{row}.*")
    return once.union(marked.where(F.col(row).isNull()).select(*names)).union(rows.where(~suspect).select(*names))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
z AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
i AS (SELECT a.rid AS x, b.rid AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM i JOIN z p ON p.rid = x JOIN z q ON q.rid = y WHERE 100 * m >= 80 * (p.n + q.n - m)),
adj AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, adj.y FROM r JOIN adj ON adj.x = r.b),
c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id IS NOT DISTINCT FROM c.component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN z USING (rid)
"""
