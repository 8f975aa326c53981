"""Corpora: files as tables, size-capped prefixes and samples, extraction from pages, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, low: int = 0, high: int | None = None) -> DataFrame:
    """path and data (bytes ``low`` to ``high``) of each file."""
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", sliced(F.col("content"), low, high).alias("data"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """The same files as an unbounded stream."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", "*").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)


def sliced(b: Column, low: int = 0, high: int | None = None) -> Column:
    return F.substring(b, low + 1, (high - low) if high is not None else (1 << 31) - 1)


def write_blobs(df: DataFrame, path: str, force: bool = False) -> None:
    """Write as Parquet; what is already there is replaced only with ``force``."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def running_bytes(df: DataFrame, bucket: Column, order: list[Column], size: Column) -> DataFrame:
    """``df`` with cum_bytes in an order that refines the buckets' order.

    Sums of the buckets are added up first (one row a bucket), then each bucket
    runs by itself, so no task sees the whole table.
    """
    rows = df.withColumns({"__bucket": bucket, "__size": size.cast("bigint")})
    sums = rows.groupBy("__bucket").agg(F.sum("__size").alias("__sum"))
    before = sums.select("__bucket", (F.sum("__sum").over(Window.orderBy("__bucket")) - F.col("__sum")).alias("__before"))
    own = F.sum("__size").over(Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before, "__bucket").withColumn("cum_bytes", F.col("__before") + own).drop("__bucket", "__size", "__before")


def prefix(df: DataFrame, most_bytes: int, id_col: str = "doc_id", text_col: str = "text", bucket_ids: int = 4096) -> DataFrame:
    """Documents in id order as long as they add up to at most ``most_bytes``."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    return running_bytes(df, F.floor(F.col(id_col) / bucket_ids), [F.col(id_col)], size).where(F.col("cum_bytes") <= most_bytes)


def sample(df: DataFrame, most_bytes: int, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in a seeded random order as long as they add up to at most ``most_bytes``."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    return running_bytes(df.withColumn("order_key", order), F.substring("order_key", 1, 4), [F.col("order_key")], size).where(F.col("cum_bytes") <= most_bytes)


def links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Distinct local links (no namespace, so no colon) and the number of pages that have them."""
    found = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(html_col, F.lit('href="/([^":]*)"'), 1))).alias("link"))
    return found.groupBy("link").agg(F.count("*").alias("n_pages"))


def strip_markup(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, blanks are joined."""
    out = F.regexp_replace(html, "(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))


def content_flags(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Whether a text is pure ASCII and whether it holds zeros: the extractor's filters."""
    t = F.col(text_col)
    return df.withColumns({"is_ascii": F.octet_length(t) == F.char_length(t), "has_zero": F.instr(t, "\0") > 0})


def distinct_lines(df: DataFrame, text_col: str = "text", seed: int = 1) -> DataFrame:
    """Each distinct line that isn't empty, how often it is there, and a seeded random order."""
    lines = df.select(F.explode(F.split(text_col, "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n")).withColumn("order_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("line"))))
