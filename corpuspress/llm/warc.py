"""WARC archives: written with revisit records, read back by boundary chains.

Writing.  The smallest page id of each payload digest is found by a two-level
aggregation (digest and salt, then digest), so a payload that a third of all
pages share is spread over ``SALTS`` keys; only payloads found twice or more are
joined back, on digest and salt.  Each task writes files of its own under fresh
names and returns their names; the list is written to the shared folder, so only
files of tasks that succeeded are ever read, however often tasks are retried.

Reading.  Archives are cut at fixed offsets without regard to records.  A task
finds everything in its cut that looks like a record (the magic may also stand
inside a payload), parses it and emits its offset and its successor's.  Within
the cut the chain from each candidate is followed to the first offset beyond the
cut; between cuts, pointer jumping from offset 0 doubles the distance each round
and marks the true entry of each cut; inside a cut the records that its entry
reaches are kept.  Magic inside a payload is never reached.

Defined cases: a null payload is an empty one; a null page id is written without
one and read back as null; a null or odd URL is left out or percent-encoded;
rows with the smallest page id of their payload are all responses (ties, repeated
rows), the others revisit it; without any non-null id among equal payloads all
are responses, and beside a non-null one a null id revisits it; a damaged record
ends its file's chain; a very long header or payload is read as far as it goes (one
record is held at a time, beside its cut); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SALTS = 64
#: Tasks of the scan to a core of the cluster.
MOST_WAVES = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "path string, cut bigint, off bigint, next bigint, `exit` bigint, page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def open_fs(url: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in url and not url.startswith("file:"):
        return pa.fs.LocalFileSystem(), url
    if url.startswith("file:"):
        return pa.fs.LocalFileSystem(), common.local_path(url)
    return pa.fs.FileSystem.from_uri(url)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record with its closing blank lines; a revisit leaves the payload out."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    if page is None:
        head.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>")
    else:
        head.append(f"WARC-Record-ID: <urn:page:{quote(page, safe='')}>")
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='')}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_originals(pages: DataFrame, id_col: str, url_col: str | None, payload_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload, refers_to (null for responses)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).alias("page_id"), (F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")).alias("url"), payload.alias("payload"))
    base = base.withColumn("sha", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    part = base.where(F.length("payload") >= min_bytes).groupBy("sha", "salt").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    whole = part.groupBy("sha").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))  # SALTS entries at most
    # Written first, so that Spark knows its size and broadcasts it only below its own threshold.
    found = common.written(whole.where("n > 1 AND first IS NOT NULL").select("sha", "first", F.explode("salts").alias("salt")), "originals")
    joined = base.join(found, ["sha", "salt"], "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", min_bytes: int = 0, gzip: bool = False, file_bytes: int = 256 << 20) -> DataFrame:
    """Write the archives; returns path, size, records of each file."""
    rows = with_originals(pages, id_col, url_col, payload_col, min_bytes).select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out, made = None, []
        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size, count = f"{root}/{uuid.uuid4().hex}.warc" + ".gz" * gzip, 0, 0
                    out = fs.open_output_stream(name, compression=None)
                data = record(page, url, payload, refers)
                if gzip:
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = squeeze.compress(data) + squeeze.flush()
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    out, made = None, [*made, (name, size, count)]
        if out is not None:
            out.close()
            made.append((name, size, count))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], ["path", "size", "records"])

    return common.written(rows.mapInArrow(run, "path string, size bigint, records bigint"), "archives")


class Cut:
    """Bytes of a file from one offset on, read further as they are asked for."""

    def __init__(self, file: pa.NativeFile, start: int, end: int):
        self.file, self.start, self.size = file, start, file.size()
        self.data = file.read_at(min(end + 8, self.size) - start, start)

    def upto(self, end: int) -> bytes:
        """At least the bytes before relative offset ``end``, as far as the file has them."""
        have = len(self.data)
        if end > have and self.start + have < self.size:
            self.data += self.file.read_at(min(max(end - have, have // 2, 1 << 20), self.size - self.start - have), self.start + have)
        return self.data

    def find(self, what: bytes, at: int) -> int:
        """Where ``what`` is found next, -1 if nowhere in the file.  Each record ends with a blank line, so in an archive no header is looked for beyond the record it stands in."""
        step = 1 << 16
        while (found := self.data.find(what, at)) < 0 and self.start + len(self.data) < self.size:
            at, step = max(at, len(self.data) - len(what) + 1), 2 * step
            self.upto(len(self.data) + step)
        return found


def parse(data: bytes) -> dict | None:
    """Fields of a whole record, or None if it isn't one."""
    stop = data.find(b"\r\n\r\n")
    if stop < 0 or not data.startswith(b"WARC/1."):
        return None
    head = {}
    for line in data[:stop].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        head[k.strip().lower()] = v.strip().decode("utf-8", "replace")
    try:
        length = int(head[b"content-length"])
    except (KeyError, ValueError):
        return None
    return {"head": head, "block": stop + 4, "end": stop + 4 + length + 4} if length >= 0 else None


def page_of(value: str | None) -> str | None:
    from urllib.parse import unquote

    return unquote(value[10:-1]) if value and value.startswith("<urn:page:") and value.endswith(">") else None


def fields(found: dict, data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    head, block = found["head"], data[found["block"] : found["end"] - 4]
    kind = head.get(b"warc-type", "")
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        size = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
        sha = head.get(b"warc-payload-digest", "").removeprefix("sha1:")
    else:
        size, sha = len(payload), digest(payload)
    return page_of(head.get(b"warc-record-id")), size, sha, kind, page_of(head.get(b"warc-refers-to"))


def candidates(file: pa.NativeFile, start: int, end: int, gzip: bool) -> Iterator[tuple]:
    """(offset, successor, fields) of all that looks like a whole record and starts in [start, end)."""
    cut, magic, at = Cut(file, start, end), b"\x1f\x8b\x08" if gzip else b"WARC/1.", -1
    while (at := cut.data.find(magic, at + 1, end - start + len(magic) - 1)) >= 0:
        if gzip:
            inflate, parts, fed = zlib.decompressobj(31), [], at
            try:
                while not inflate.eof:
                    data = cut.upto(fed + 1)
                    if len(data) <= fed:
                        break
                    step = min(len(data), fed + (1 << 16))
                    parts.append(inflate.decompress(data[fed:step]))
                    fed = step
                    if len(parts) == 1 and parts[0] and not b"WARC/1.".startswith(parts[0][:7]):
                        break
            except zlib.error:
                continue
            if not inflate.eof:
                continue
            body, after = b"".join(parts), fed - len(inflate.unused_data)
            found = parse(body)
            if found is None or found["end"] != len(body):
                continue
        else:
            stop = cut.find(b"\r\n\r\n", at)
            found = parse(cut.data[at : stop + 4]) if stop >= 0 else None
            if found is None or cut.start + at + found["end"] > cut.size:
                continue
            body = cut.upto(at + found["end"])[at : at + found["end"]]
            if not body.endswith(b"\r\n\r\n"):
                continue
            after = at + found["end"]
        yield start + at, start + after, fields(found, body)


def read_warc(spark: SparkSession, files: DataFrame, cut_bytes: int = 16 << 20) -> DataFrame:
    """The records of the archives (path, size) that their chains reach from offset 0.

    A task takes as many cuts as it must, one at a time, so tasks don't grow in number with the archives.
    """
    cuts = files.select("path", "size", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {cut_bytes}L)")).alias("start"))
    n = max(1, min(cuts.count(), MOST_WAVES * spark.sparkContext.defaultParallelism))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                end = min(start + cut_bytes, size)
                fs, name = open_fs(path)
                with fs.open_input_file(name) as file:
                    rows = list(candidates(file, start, end, path.endswith(".gz")))
                beyond: dict[int, int] = {}
                for off, after, _ in reversed(rows):
                    beyond[off] = (after if after < size else -1) if after >= end else beyond.get(after, -1)
                table = [(path, start, off, after, beyond[off], *f) for off, after, f in rows]
                if table:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table), ARROW)], NAMES)

    seen = common.written(cuts.repartition(n, "path", "start").mapInArrow(scan, RECORD), "candidates")
    entries = reachable_entries(seen, files, cut_bytes)
    joined = seen.join(entries.select("path", F.floor(F.col("off") / cut_bytes).cast("bigint").alias("k"), F.col("off").alias("entry")), (entries["path"] == seen["path"]) & (F.floor(seen["cut"] / cut_bytes) == F.col("k")))
    joined = joined.select(seen["path"], *(c for c in NAMES if c != "path"), "entry")

    def chain(table: pa.Table) -> pa.Table:
        """Records of one cut that its entry reaches; a cut's bytes bound the group."""
        table = table.sort_by("off")
        keep, at = [], table.column("entry")[0].as_py()
        for i, (off, after) in enumerate(zip(table.column("off").to_pylist(), table.column("next").to_pylist())):
            if off == at:
                keep.append(i)
                at = after
        return table.take(pa.array(keep, pa.int64())).drop_columns(["entry"])

    return joined.groupBy("path", "cut").applyInArrow(chain, RECORD)


NAMES = ["path", "cut", "off", "next", "exit", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
ARROW = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), *[pa.string()] * 3]


def reachable_entries(seen: DataFrame, files: DataFrame, cut_bytes: int) -> DataFrame:
    """(path, off) of the record with which each cut truly begins, by pointer jumping."""
    targets = seen.where("`exit` >= 0").select("path", F.col("exit").alias("off")).union(files.select("path", F.lit(0).cast("bigint").alias("off"))).distinct()
    jump = common.written(seen.join(targets, ["path", "off"], "semi").select("path", "off", F.col("exit").alias("to")), "jumps")
    reach = files.select("path", F.lit(0).cast("bigint").alias("off"))
    most = files.agg(F.max("size")).first()[0] or 0
    far = 1
    while far <= most // cut_bytes:  # a chain has at most one entry in each cut
        step = reach.join(jump, ["path", "off"]).select("path", F.col("to").alias("off")).where("off >= 0")
        reach = common.written(reach.union(step).distinct(), "reach")
        onward = jump.alias("a").join(jump.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.to") == F.col("b.off")))
        jump = common.written(onward.select("a.path", "a.off", "b.to"), "jumps")
        far *= 2
    return reach


def op2_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through plain archives, whose payloads show all the magic they hold."""
    pages = common.read(spark, sf_dir, "pages")
    files = write_warc(pages, common.shared_dir(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    got = read_warc(spark, files)
    return got.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


_B32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> {}) & 31) + 1 AS BIGINT), 1)"
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: list_transform([CAST('0x' || substr(sha, CAST(g * 5 + 1 AS BIGINT), 5) AS BIGINT)], lambda v:
    {" || ".join(_B32.format(b) for b in (15, 10, 5, 0))})[1]), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h
"""
