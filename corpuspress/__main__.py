"""python -m corpuspress -a ALGORITHM [-d] [-f] [-l] [-g GENERATOR] [-s] INPUT -o OUTPUT: compress files.

Each input file becomes a row of Parquet (path, data); with -d the rows are
unpacked again, by the algorithm that each row names unless -a gives one.  With
"-" as the input (or --usestdin) one blob is read from standard input, and with "-"
as the output (or --usestdout) it goes to standard output; these two need no Spark.
-s prints phases as JSON, with sizes and rate.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.stats import Phases
from .plans import registry
from .session import attach
from .sources import corpus

VERSION = "corpuspress 0.2"


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpuspress", description=__doc__)
    p.add_argument("input", nargs="?")
    p.add_argument("-a", "--algorithm")
    p.add_argument("-d", "--decompress", action="store_true")
    p.add_argument("-f", "--force", action="store_true")
    p.add_argument("-g", "--generator")
    p.add_argument("-l", "--list", action="store_true")
    p.add_argument("-o", "--output")
    p.add_argument("-s", "--stats", action="store_true")
    p.add_argument("--raw", action="store_true", help="no header that names the algorithm")
    p.add_argument("--usestdin", action="store_true")
    p.add_argument("--usestdout", action="store_true")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    o = p.parse_args(args)
    if o.usestdin:
        o.input, o.output = "-", o.output or o.input  # the only name that is left is the output's
    if o.usestdout:
        o.output = "-"
    if o.generator:
        sys.stdout.buffer.write(registry.generate(o.generator))
        return 0
    if o.input == "-" and (o.algorithm or o.decompress):
        return piped(o)
    spark = attach(SparkSession.builder.getOrCreate())
    if o.list:
        registry.list_algorithms(spark).show(1000, truncate=False)
        return 0
    if not o.input or not o.output or not (o.algorithm or o.decompress):
        p.error("an input, an output and an algorithm are needed")
    if o.output == "-":
        p.error("files go to a folder; standard output takes what comes from standard input")
    phases = Phases("decompress" if o.decompress else "compress")
    phases.log("config", o.algorithm)
    if o.decompress:
        rows = spark.read.parquet(o.input)
        data = registry.decompress(F.col("data"), o.algorithm) if o.algorithm and o.raw else registry.unpack(F.col("data"))
    else:
        rows = corpus.read_files(spark, o.input)
        data = registry.compress(F.col("data"), o.algorithm) if o.raw else registry.pack(F.col("data"), o.algorithm)
    with phases("write"):
        corpus.write_blobs(rows.select("path", data.alias("data")), o.output, o.force)
    if o.stats:
        sizes = [df.agg(F.sum(F.octet_length("data"))).first()[0] or 0 for df in (rows, spark.read.parquet(o.output))]
        measured(phases, *sizes)
        print(phases.to_json())
    return 0


def measured(phases: Phases, before: int, after: int) -> None:
    phases.log("inputSize", before)
    phases.log("outputSize", after)
    phases.log("rate", after / before if before else 0.0)


def piped(o: argparse.Namespace) -> int:
    """One blob from standard input, to standard output or a file."""
    phases = Phases("decompress" if o.decompress else "compress")
    phases.log("config", o.algorithm)
    data = sys.stdin.buffer.read()
    with phases("code"):
        if not o.decompress:
            out = registry.codec(o.algorithm).forward(data)
            out = out if o.raw else registry.canonical(o.algorithm).encode() + b"%" + out
        elif o.raw:
            out = registry.codec(o.algorithm).backward(data)
        else:
            out = registry.unpack_bytes(data)
    if o.output in (None, "-"):
        sys.stdout.buffer.write(out)
        sys.stdout.buffer.flush()
    else:
        with open(o.output, "wb" if o.force else "xb") as f:
            f.write(out)
    if o.stats:
        measured(phases, len(data), len(out))
        print(phases.to_json(), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
