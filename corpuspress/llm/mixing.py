"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic) with map-side combine, so a
hot source costs one row a task.  Raking scales the cells until each marginal
has its target share.  No cell may weigh more than 1 / fraction, since a document
is sampled with the probability fraction * weight: the raking is bounded there,
and cells below the bound make up for what those at it can't.  So the expected
sample has the target shares, and ``fraction`` of all tokens.  Where that can't
be (a value has fewer tokens than its share of the sample), the fraction is
lowered in steps of ``STEP`` until it can; targets that no fraction meets (a
marginal whose cells are empty) are met as far as raking gets, which ``shares``
reports.  ``repeated`` reaches the targets at any fraction, with documents of cells
that are short taken more than once.

A document is sampled if a number in [0, 1) that depends on its id alone is below
its cell's probability.

Up to ``most_cells`` cells the fit is numpy on the driver and the weights are
broadcast (that number bounds both); beyond it the same sweeps, with the same
bound and the same test of convergence, run as aggregations over the table of
cells, and the weights are joined with salts.

Defined cases: a null source or language is a value of its own ("(none)"), a
null or empty text has no tokens and the topic "general"; cells without tokens are
weighted like others of their values; rows that repeat or share an id share the
number drawn; a very long text is one row of one batch, read in linear time; an empty table
gives an empty result; all that the operator adds is in one column whose name no
input column has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The first rule that matches names the topic.
TOPICS = (("legal", "(?i)(license|copyright|rights reserved)"), ("contact", "[A-Za-z0-9.]+@[A-Za-z0-9.]+"), ("tabular", "[|][^|\\n]+[|]"), ("numeric", "[0-9]{3}"))
DIMS = ("source", "lang", "topic")
#: Exponents of the natural shares that give the target shares.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Raking ends when no marginal is farther from its target, as a share of all tokens; fractions with a larger gap than LOOSE are lowered.
TIGHT, LOOSE, MOST_SWEEPS, STEP = 1e-13, 1e-7, 400, 0.95
#: Halvings in the search for a scale of targets.
HALVINGS = 60
FRACTION = 0.4


def topics_of(text: pa.Array) -> pa.Array:
    """The topic of each text; the expressions are searched in linear time, however long a run of letters is."""
    return pc.case_when(pa.StructArray.from_arrays([pc.match_substring_regex(text, rule) for _, rule in TOPICS], [name for name, _ in TOPICS]), *(name for name, _ in TOPICS), "general")


def topics_and_tokens():
    """A function of a text column without nulls: a struct of its topic and its number of words."""

    @F.arrow_udf("topic string, tokens bigint")
    def run(text: pa.Array) -> pa.Array:
        out = []
        for part in common.slices([pa.RecordBatch.from_arrays([text], ["text"])], "text"):
            words = common.Words(*common.text_buffer(part.column(0)))
            out.append(pa.StructArray.from_arrays([topics_of(part.column(0)), pa.array(words.count, pa.int64())], ["topic", "tokens"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("topic", pa.string()), ("tokens", pa.int64())]))

    return run


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> tuple[DataFrame, str]:
    """The documents with a struct of source, lang, topic, tokens and the number drawn, u; and the struct's name."""
    none, text = F.lit("(none)"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    mix, read = common.free(docs.columns, "mix", "read")
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), none).cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    return docs.withColumn(read, topics_and_tokens()(text)).withColumn(mix, F.struct(
        F.coalesce(F.col(f"`{source_col}`").cast("string"), none).alias("source"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), none).alias("lang"),
        F.col(f"{read}.topic").alias("topic"),
        F.col(f"{read}.tokens").alias("tokens"),
        drawn.alias("u"),
    )).drop(read), mix


def targets(tokens: dict[str, dict[str, float]], wanted: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER, boost: float = float("inf")) -> dict[str, dict[str, float]]:
    """Target share of each value: the wanted one if given, else the tempered natural share, but at most ``boost`` times the natural one."""
    out = {}
    for dim in DIMS:
        own, whole = (wanted or {}).get(dim), sum(tokens[dim][v] for v in sorted(tokens[dim]))
        raw = {v: (own.get(v, 0.0) if own else (n ** temper[dim] if n > 0 else 0.0)) for v, n in tokens[dim].items()}
        total = sum(raw[v] for v in sorted(raw))
        found = {v: x / total if total else 0.0 for v, x in raw.items()}
        if not own and total and boost < float("inf"):
            most = {v: boost * n / whole for v, n in tokens[dim].items()}
            c = scale_of(lambda c, most=most, found=found: sum(min(most[v], c * found[v]) for v in sorted(found)))
            found = {v: min(most[v], c * x) for v, x in found.items()}
        out[dim] = found
    return out


def scale_of(sum_at) -> float:
    """The c, 1 or more, for which ``sum_at(c)``, which grows with it, is 1."""
    low, high = 1.0, 2.0
    while sum_at(high) < 1 - 1e-15 and high < 1e12:
        low, high = high, 2 * high
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        low, high = (middle, high) if sum_at(middle) < 1 else (low, middle)
    return high


def rake(cells: list[tuple], aims: dict[str, dict[str, float]], most: float = float("inf")) -> tuple[np.ndarray, float]:
    """Weights of the cells (source, lang, topic, tokens), at most ``most`` each, and the largest gap of a marginal."""
    tokens = np.array([c[3] for c in cells], float)
    weight, total = np.ones(len(cells)), tokens.sum()
    dims = []
    for d, dim in enumerate(DIMS):
        values, at = np.unique(np.array([c[d] for c in cells], object).astype(str), return_inverse=True)
        dims.append((at, len(values), np.array([aims[dim][v] for v in values]) * total))
    last = float("inf")
    for sweep in range(MOST_SWEEPS):
        for at, n, aim in dims:
            have = np.bincount(at, weight * tokens, n)
            weight = np.minimum(most, weight * np.where(have > 0, aim / np.where(have > 0, have, 1), 1.0)[at])
        gap = max((float(np.abs(np.bincount(at, weight * tokens, n) - aim).max()) / total for at, n, aim in dims), default=0.0) if total else 0.0
        if gap < TIGHT or stalled(sweep, gap, last):
            break
        last = gap
    return weight, gap


def stalled(sweep: int, gap: float, last: float) -> bool:
    """Whether so little is gained that the targets are out of reach."""
    return sweep >= 20 and gap > LOOSE and gap > last * 0.995


def cells_of(features: DataFrame, mix: str) -> DataFrame:
    return features.groupBy(*(F.col(f"{mix}.{d}").alias(d) for d in DIMS)).agg(F.sum(f"{mix}.tokens").alias("tokens"))


def fit_local(cells: list[tuple], wanted: dict | None, fraction: float, bounded: bool = True, temper: dict[str, float] = TEMPER, boost: float = float("inf")) -> list[tuple]:
    """(source, lang, topic, weight, target fraction) of each cell."""
    cells = sorted((s, l, t, float(n)) for s, l, t, n in cells)
    sums: dict[str, dict[str, float]] = {d: {} for d in DIMS}
    for c in cells:
        for d, dim in enumerate(DIMS):
            sums[dim][c[d]] = sums[dim].get(c[d], 0.0) + c[3]
    aims = targets(sums, wanted, temper, boost)
    free, reachable = rake(cells, aims)
    total = sum(c[3] for c in cells)
    if bounded and total:  # a value's share of the sample can't be more than all of its tokens
        fraction = min([fraction, *(sums[d][v] / total / aim for d in DIMS for v, aim in aims[d].items() if aim > 0 and sums[d][v] > 0)])
    if not bounded or not len(cells):
        return [(*c[:3], float(w), fraction) for c, w in zip(cells, free)]
    while True:
        if fraction * free.max() <= 1:  # no bound binds
            weight = free
            break
        weight, gap = rake(cells, aims, 1 / fraction)
        if gap <= max(LOOSE, reachable):
            break
        fraction *= STEP
    return [(*c[:3], float(w), fraction) for c, w in zip(cells, weight)]


def rake_spark(cells: DataFrame, aims: dict[str, DataFrame], total: float, most: float) -> tuple[DataFrame, float]:
    """``rake`` for any number of cells: marginals are aggregations, factors are joined back."""
    cells, last = cells.withColumn("weight", F.lit(1.0)), float("inf")
    for sweep in range(MOST_SWEEPS):
        for dim in DIMS:
            have = cells.groupBy(dim).agg(F.sum(F.col("weight") * F.col("tokens")).alias("have")).join(aims[dim], dim)
            factor = have.select(dim, F.when(F.col("have") > 0, F.col("aim") * total / F.col("have")).otherwise(1.0).alias("factor"))
            cells = cells.join(factor, dim).select(*DIMS, "tokens", F.least(F.lit(most), F.col("weight") * F.col("factor")).alias("weight"))
        cells = common.written(cells, "raked")
        off = None
        for dim in DIMS:
            part = cells.groupBy(dim).agg(F.sum(F.col("weight") * F.col("tokens")).alias("have")).join(aims[dim], dim).select(F.abs(F.col("have") - F.col("aim") * total).alias("off"))
            off = part if off is None else off.union(part)
        gap = (off.agg(F.max("off")).first()[0] or 0.0) / total if total else 0.0
        if gap < 1e-11 or stalled(sweep, gap, last):
            break
        last = gap
    return cells, gap


def fit_spark(cells: DataFrame, wanted: dict | None, fraction: float, bounded: bool = True, temper: dict[str, float] = TEMPER, boost: float = float("inf")) -> DataFrame:
    """``fit_local`` for any number of cells."""
    spark, cells = cells.sparkSession, common.written(cells.withColumn("tokens", F.col("tokens").cast("double")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    aims, rooms = {}, [fraction]
    for dim in DIMS:
        sums = cells.groupBy(dim).agg(F.sum("tokens").alias("n"))
        own = (wanted or {}).get(dim)
        raw = sums.join(spark.createDataFrame([(v, float(x)) for v, x in own.items()], f"{dim} string, raw double"), dim, "left").fillna(0.0, ["raw"]) if own else sums.withColumn("raw", F.when(F.col("n") > 0, F.pow("n", F.lit(temper[dim]))).otherwise(0.0))
        raw = common.written(raw, "aims")
        whole = raw.agg(F.sum("raw")).first()[0] or 0.0
        if not own and whole and boost < float("inf"):
            most = F.col("n") * (boost / total)
            c = scale_of(lambda c, raw=raw, most=most, whole=whole: raw.agg(F.sum(F.least(most, F.col("raw") * (c / whole)))).first()[0])
            raw, whole = raw.withColumn("raw", F.least(most, F.col("raw") * (c / whole))), 1.0
        aims[dim] = raw.select(dim, (F.col("raw") / whole if whole else F.lit(0.0)).alias("aim"))
        rooms.append(raw.where("raw > 0 AND n > 0").agg(F.min(F.col("n") / F.col("raw"))).first()[0])
        rooms[-1] = rooms[-1] * whole / total if rooms[-1] and total else fraction
    fraction = min(rooms) if bounded else fraction
    weight, reachable = rake_spark(cells, aims, total, float("inf"))
    largest = weight.agg(F.max("weight")).first()[0] or 0.0
    free = weight
    while bounded and fraction * largest > 1:
        weight, gap = rake_spark(cells, aims, total, 1 / fraction)
        if gap <= max(LOOSE, reachable):
            break
        fraction *= STEP
        if fraction * largest <= 1:
            weight = free
    return weight.select(*DIMS, "weight", F.lit(fraction).alias("fraction"))


WEIGHTS = T.StructType([*(T.StructField(d, T.StringType()) for d in DIMS), T.StructField("weight", T.DoubleType()), T.StructField("fraction", T.DoubleType())])


def weighted(features: DataFrame, mix: str, wanted: dict | None = None, fraction: float = FRACTION, bounded: bool = True, temper: dict[str, float] = TEMPER, boost: float = float("inf"), most_cells: int = 100_000, salts: int = 32) -> DataFrame:
    """``featured`` rows whose struct also has weight, probability, sampled, and copies, which are fraction * weight on average."""
    cells = common.written(cells_of(features, mix), "cells")
    if cells.count() <= most_cells:
        found = features.sparkSession.createDataFrame(fit_local([tuple(r) for r in cells.collect()], wanted, fraction, bounded, temper, boost), WEIGHTS)
        salt, found = F.lit(0), F.broadcast(found.withColumn("salt", F.lit(0)))
    else:
        salt = F.pmod(F.xxhash64(f"{mix}.u", f"{mix}.tokens"), F.lit(salts)).cast("int")
        found = fit_spark(cells, wanted, fraction, bounded, temper, boost).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    names = [F.col(f"`{c}`") for c in features.columns if c != mix]
    (fit,) = common.free(features.columns, "fit")
    found = found.select(F.struct(*DIMS, "salt").alias(fit), F.struct("weight", "fraction").alias(fit + "ted"))
    key = F.struct(*(F.col(f"{mix}.{d}").alias(d) for d in DIMS), salt.alias("salt"))
    joined = features.withColumn(fit, key).join(found, fit)
    weight, share, u = F.col(f"{fit}ted.weight"), F.col(f"{fit}ted.fraction"), F.col(f"{mix}.u")
    probability = F.least(F.lit(1.0), share * weight)
    more = F.struct(f"{mix}.*", weight.alias("weight"), probability.alias("probability"), (u < probability).alias("sampled"), F.ceil(share * weight - u).cast("bigint").alias("copies"))
    return joined.select(*names, more.alias(mix))


def sample(docs: DataFrame, wanted: dict | None = None, fraction: float = FRACTION, temper: dict[str, float] = TEMPER, boost: float = float("inf"), **columns: str) -> DataFrame:
    """The documents that are sampled, with their own columns."""
    features, mix = featured(docs, **columns)
    return weighted(features, mix, wanted, fraction, temper=temper, boost=boost).where(f"{mix}.sampled").select(*(F.col(f"`{c}`") for c in docs.columns))


def repeated(features: DataFrame, mix: str, wanted: dict | None = None, fraction: float = FRACTION, **bounds: int) -> DataFrame:
    """``weighted`` rows, each as often as its copies say: weights have no bound, so expected shares are the targets at any fraction."""
    names = [F.col(f"`{c}`") for c in features.columns]
    got = weighted(features, mix, wanted, fraction, bounded=False, **bounds).where(f"{mix}.copies > 0")
    (copy,) = common.free(features.columns, "copy")
    return got.select(*names, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"{mix}.copies"))).alias(copy))


def shares(rows: DataFrame, mix: str) -> DataFrame:
    """dim, value, and the value's share of all tokens, of the weighted tokens and of the expected sample."""
    tokens = F.col(f"{mix}.tokens")
    sums = [F.sum(tokens).alias("natural"), F.sum(tokens * F.col(f"{mix}.weight")).alias("weighted"), F.sum(tokens * F.col(f"{mix}.probability")).alias("expected")]
    cells = common.written(rows.groupBy(*(F.col(f"{mix}.{d}").alias(d) for d in DIMS)).agg(*sums), "shares")
    total = cells.agg(*(F.sum(c).alias(f"all_{c}") for c in ("natural", "weighted", "expected")))
    out = None
    for dim in DIMS:
        part = cells.groupBy(F.lit(dim).alias("dim"), F.col(dim).alias("value")).agg(*(F.sum(c).alias(c) for c in ("natural", "weighted", "expected")))
        out = part if out is None else out.union(part)
    return out.join(F.broadcast(total)).select("dim", "value", *((F.col(c) / F.col(f"all_{c}")).alias(c) for c in ("natural", "weighted", "expected")))  # one row of totals


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, mix = featured(common.read(spark, sf_dir, "documents"))
    got = weighted(common.written(features.select("doc_id", mix), "features"), mix)
    return got.select(
        "doc_id", f"{mix}.source", f"{mix}.lang", f"{mix}.topic", F.col(f"{mix}.tokens").alias("n_tokens"),
        F.round(f"{mix}.weight", 6).alias("weight"), F.round(f"{mix}.probability", 6).alias("probability"), f"{mix}.sampled",
    )


def sql(sweeps: int = 150, fraction: float = FRACTION) -> str:
    """The same bounded sweeps, many more than they need to converge, at a fraction that can be reached."""
    case = " ".join("WHEN regexp_matches(text, '" + rule.replace("(?i)", "") + "'" + (", 'i'" if rule.startswith("(?i)") else "") + f") THEN '{name}'" for name, rule in TOPICS)
    inner, columns = "r", "k, source, lang, topic, n, total, " + ", ".join(f"a_{d}" for d in DIMS)
    for dim in DIMS:
        inner = f"(SELECT {columns}, least({1 / fraction!r}::DOUBLE, w * CASE WHEN h > 0 THEN a_{dim} * total / h ELSE 1 END) AS w FROM (SELECT *, sum(w * n) OVER (PARTITION BY {dim}) AS h FROM {inner}))"
    aims = ", ".join(f"(CASE WHEN n_{d} > 0 THEN pow(n_{d}, {TEMPER[d]}) ELSE 0 END) / (SELECT sum(CASE WHEN x > 0 THEN pow(x, {TEMPER[d]}) ELSE 0 END) FROM (SELECT sum(n) AS x FROM c0 GROUP BY {d})) AS a_{d}" for d in DIMS)
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text FROM documents),
f AS MATERIALIZED (SELECT doc_id, source, lang, CASE {case} ELSE 'general' END AS topic,
  CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '(none)')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM d),
c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM f GROUP BY ALL),
c AS MATERIALIZED (SELECT 0 AS k, source, lang, topic, n, total, {aims}, 1.0::DOUBLE AS w
  FROM (SELECT *, sum(n) OVER () AS total, {", ".join(f"sum(n) OVER (PARTITION BY {d}) AS n_{d}" for d in DIMS)} FROM c0)),
r AS (SELECT * FROM c UNION ALL SELECT k + 1, {columns[3:]}, w FROM {inner} WHERE k < {sweeps})
SELECT doc_id, source, lang, topic, n_tokens, round(w, 6) AS weight, round(least(1.0, {fraction} * w), 6) AS probability, u < least(1.0, {fraction} * w) AS sampled
FROM f JOIN (SELECT source, lang, topic, w FROM r WHERE k = {sweeps}) USING (source, lang, topic)"""


OP3_SQL = sql()
