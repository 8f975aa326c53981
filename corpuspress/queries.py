"""The registered queries of the engine and, where SQL can say the same, their SQL.

Every query runs over its whole tables and whole texts.  Code lengths and
codewords are Catalyst expressions; indexes and codecs run over Arrow batches.
Where the SQL needs suffixes of texts (bytes grow with the square of a text's
length), the corpus is the table of short texts, ``conversations``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, hashes
from .operators import compare, grammar, index, lz, profile, relations, transforms
from .plans import registry
from .session import spread
from .sources import corpus, generators
from .streaming import windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """The table for queries that run Python over its texts."""
    return spread(table(spark, sf_dir, name))


# Histograms, runs and entropies of documents.

BYTES = "WITH d AS (SELECT *, encode(text) AS b FROM documents WHERE text IS NOT NULL), e AS (SELECT * EXCLUDE (b, text), b, unnest(range(1, octet_length(b) + 1)) AS i FROM d), y AS (SELECT * EXCLUDE b, CAST('0x' || hex(b[i:i]) AS BIGINT) AS c FROM e)"


@query(f"""{BYTES}, h AS (SELECT lang, c, count(*) AS n FROM y GROUP BY ALL)
SELECT lang, CAST(sum(n) AS BIGINT) AS n_bytes, count(*) AS sigma, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS h0 FROM h GROUP BY lang""")
def language_entropy(spark, sf_dir):
    return text_profile(spark, sf_dir).drop("huff_bits")


#: Huffman codes cost the sum of the weights that merging the two lightest nodes makes; l: sorted weights.
_MERGE = """m AS (SELECT {0}, l, CAST(0 AS HUGEINT) AS bits FROM w UNION ALL
  SELECT {0}, list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] FROM m WHERE len(l) > 1)"""


@query(f"""WITH RECURSIVE {BYTES[5:]}, h AS (SELECT lang, c, count(*) AS n FROM y GROUP BY ALL), w AS (SELECT lang, list_sort(list(n)) AS l FROM h GROUP BY lang), {_MERGE.format("lang")},
p AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n_bytes, count(*) AS sigma, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS h0 FROM h GROUP BY lang)
SELECT lang, n_bytes, sigma, h0, round(CASE WHEN sigma > 1 THEN CAST(bits AS DOUBLE) ELSE n_bytes END / n_bytes, 9) AS huff_bits FROM p JOIN m USING (lang) WHERE len(l) = 1""")
def text_profile(spark, sf_dir):
    return profile.text_profile(texts(spark, sf_dir), ["lang"])


@query(f"{BYTES} SELECT lang, source, c, count(*) AS n FROM y GROUP BY ALL")
def byte_histogram(spark, sf_dir):
    return profile.byte_histogram(texts(spark, sf_dir), ["lang", "source"])


@query(f"{BYTES} SELECT doc_id, count(DISTINCT c) AS sigma FROM y GROUP BY doc_id")
def alphabet_size(spark, sf_dir):
    return profile.byte_histogram(texts(spark, sf_dir), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("sigma"))


def _entropy_sql(k: int) -> str:
    gram = "c"
    for j in range(1, k + 1):
        gram = f"({gram}) * 256 + lead(c, {j}) OVER (PARTITION BY doc_id ORDER BY i)"
    return f"""{BYTES}, g AS (SELECT doc_id, {gram} AS g FROM y), n AS (SELECT doc_id, g, count(*) AS n FROM g WHERE g IS NOT NULL GROUP BY ALL),
t AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id, g // 256) AS whole FROM n)
SELECT doc_id, round(coalesce(sum(n * log2(whole / n)), 0) / any_value(octet_length(encode(text))), 7) AS h FROM documents JOIN t USING (doc_id) GROUP BY doc_id"""


def _entropy(k: int):
    def run(spark, sf_dir):
        found = profile.entropies(texts(spark, sf_dir).where(F.octet_length("text") > k), orders=(k,))
        return found.select("doc_id", F.round(f"h{k}", 7).alias("h"))

    run.__name__ = f"entropy_h{k}"
    return run


for _k in range(4):
    query(_entropy_sql(_k))(_entropy(_k))

RUNS = f"{BYTES}, s AS (SELECT doc_id, i, c, CASE WHEN c IS DISTINCT FROM lag(c) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS start FROM y), u AS (SELECT doc_id, sum(start) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s), r AS (SELECT doc_id, run, count(*) AS n FROM u GROUP BY ALL)"


@query(f"{RUNS} SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run FROM r GROUP BY doc_id")
def byte_runs(spark, sf_dir):
    return profile.byte_runs(texts(spark, sf_dir)).where("n_runs > 0")


_RLE = "CASE WHEN n = 1 THEN 1 ELSE 2 + greatest(1, CAST(ceil(length(bin(CAST(n - 2 AS BIGINT))) / 7.0) AS BIGINT)) END"


@query(f"{RUNS} SELECT doc_id, CAST(sum(n) AS BIGINT) AS raw_bytes, CAST(sum({_RLE}) AS BIGINT) AS rle_bytes FROM r GROUP BY doc_id")
def rle_size(spark, sf_dir):
    return profile.rle_bytes(texts(spark, sf_dir)).where("raw_bytes > 0")


@query(f"{RUNS}, z AS (SELECT doc_id, sum(n) AS raw, sum({_RLE}) AS packed FROM r GROUP BY doc_id) SELECT lang, source, count(*) AS n_docs, CAST(sum(raw) AS BIGINT) AS raw_bytes, CAST(sum(packed) AS BIGINT) AS rle_bytes, round(sum(packed) / sum(raw), 9) AS rate FROM z JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)")
def rate_rollup(spark, sf_dir):
    sized = texts(spark, sf_dir).where("length(text) > 0").withColumn("n", F.octet_length("text")).withColumn("packed", F.octet_length(registry.compress(F.col("text"), "rle")))
    return sized.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("raw_bytes"), F.sum("packed").alias("rle_bytes"), F.round(F.sum("packed") / F.sum("n"), 9).alias("rate"))


@query(f"{BYTES}, k AS (SELECT c * 65536 + lead(c, 1) OVER (PARTITION BY doc_id ORDER BY i) * 256 + lead(c, 2) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM y) SELECT g AS kmer, count(*) AS n FROM k WHERE g IS NOT NULL GROUP BY g ORDER BY n DESC, g LIMIT 100")
def kmer_topk(spark, sf_dir):
    found = profile.expanded(texts(spark, sf_dir), [], "text", 3)
    return found.select(F.col("g").alias("kmer"), "n").orderBy(F.desc("n"), "kmer").limit(100)


@query(f"{BYTES}, k AS (SELECT lang, c AS l, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM y) SELECT lang, l, r, count(*) AS n FROM k WHERE r IS NOT NULL GROUP BY ALL")
def digram_counts(spark, sf_dir):
    found = profile.expanded(texts(spark, sf_dir), ["lang"], "text", 2)
    return found.select("lang", F.shiftright("g", 8).alias("l"), F.col("g").bitwiseAND(255).alias("r"), "n")


@query(f"{BYTES}, h AS (SELECT lang, c, count(*) AS n FROM y GROUP BY ALL) SELECT lang, c, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, c) - 1 AS rank FROM h")
def sle_ranking(spark, sf_dir):
    return profile.sle_ranking(texts(spark, sf_dir), ["lang"])


@query()
def huffman_code_lengths(spark, sf_dir):
    return profile.code_table(profile.byte_histogram(texts(spark, sf_dir), ["lang"]), ["lang"])


@query(f"""WITH RECURSIVE {BYTES[5:]}, h AS (SELECT doc_id, c, count(*) AS n FROM y GROUP BY ALL), w AS (SELECT doc_id, list_sort(list(n)) AS l FROM h GROUP BY doc_id), {_MERGE.format("doc_id")}
SELECT d.doc_id, CAST(CASE WHEN bits > 0 THEN bits ELSE 8 * strlen(text) END AS BIGINT) AS huff_bits FROM documents d LEFT JOIN (SELECT * FROM m WHERE len(l) = 1) m ON m.doc_id = d.doc_id WHERE text IS NOT NULL""")
def huffman_document_bits(spark, sf_dir):
    return profile.per_text(texts(spark, sf_dir), "doc_id", "text", {"huff_bits": "bigint"}, lambda b: (profile.huffman_bits(b),))


# Integer codes.

_W = "length(bin({0}))"
_TERNARY = "CASE WHEN {0} = 0 THEN 2 ELSE 2 * (1 + (SELECT count(*) FROM (VALUES (3), (9), (27), (81), (243), (729), (2187), (6561), (19683), (59049), (177147), (531441), (1594323), (4782969), (14348907), (43046721), (129140163), (387420489), (1162261467)) p(v) WHERE v <= {0} - 1)) + 2 END"


def _sizes_sql() -> str:
    cols = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    parts = []
    for c in cols:
        v = f"CAST({c} AS BIGINT)"
        w = _W.format(v)
        parts.append(f"""SELECT '{c}' AS field, count(*) AS n, CAST(count(*) * greatest(1, length(bin(max({v}) - min({v})))) AS BIGINT) AS bit_bits, CAST(sum(length({v}::VARCHAR) + 1) * 8 AS BIGINT) AS ascii_bits,
  CAST(sum(2 * {w} + 1) AS BIGINT) AS gamma_bits, CAST(sum(2 * length(bin({w})) + 1 + {w}) AS BIGINT) AS delta_bits, CAST(sum(8 * ceil({w} / 7.0)) AS BIGINT) AS vbyte_bits, CAST(sum({v} + 1) AS BIGINT) AS unary_bits FROM lineitem""")
    return " UNION ALL ".join(parts)


@query(_sizes_sql())
def code_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("bigint").alias("v")) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))).alias("x")).select("x.*")
    v = F.col("v")
    return rows.groupBy("field").agg(
        F.count("*").alias("n"), (F.count("*") * bits.width(F.max(v) - F.min(v))).alias("bit_bits"), (8 * F.sum(F.length(bits.ascii_word(v)))).alias("ascii_bits"), F.sum(bits.gamma_bits(v)).alias("gamma_bits"),
        F.sum(bits.delta_bits(v)).alias("delta_bits"), (8 * F.sum(bits.vbyte_bytes(v))).alias("vbyte_bits"), F.sum(v + 1).alias("unary_bits"),
    )


@query(f"SELECT o_orderkey, CAST({_TERNARY.format('o_orderkey')} AS BIGINT) AS ternary_bits FROM orders")
def ternary_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.ternary_bits(F.col("o_orderkey")).alias("ternary_bits"))


_G = "repeat('0', length(bin({0}))) || '1' || bin({0})"


@query(f"SELECT o_orderkey, {_G.format('o_orderkey')} AS gamma, {_G.format('CAST(length(bin(o_orderkey)) AS BIGINT)')} || bin(o_orderkey) AS delta, lpad(bin(o_orderkey), 32, '0') AS fixed, o_orderkey::VARCHAR || ':' AS ascii FROM orders")
def codewords(spark, sf_dir):
    v = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.gamma_word(v).alias("gamma"), bits.delta_word(v).alias("delta"), bits.binary_word(v, 0, (1 << 32) - 1).alias("fixed"), bits.ascii_word(v).alias("ascii"))


@query("SELECT c_custkey, repeat('0', c_nationkey) || '1' AS unary, CASE WHEN c_nationkey = 0 THEN '11' WHEN c_nationkey <= 3 THEN lpad(bin(c_nationkey - 1), 2, '0') || '11' WHEN c_nationkey <= 9 THEN lpad(bin((c_nationkey - 1) % 3), 2, '0') || lpad(bin((c_nationkey - 1) // 3), 2, '0') || '11' ELSE lpad(bin((c_nationkey - 1) % 3), 2, '0') || lpad(bin((c_nationkey - 1) // 3 % 3), 2, '0') || lpad(bin((c_nationkey - 1) // 9), 2, '0') || '11' END AS ternary FROM customer")
def small_codewords(spark, sf_dir):
    v = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", bits.unary_word(v).alias("unary"), bits.ternary_word(v).alias("ternary"))


# Text indexes of short texts, with their definitions in SQL.

SUFFIXES = r"""WITH t AS (SELECT conv_id * 1000000 + turn AS id, encode(text) || '\x00'::BLOB AS b FROM conversations WHERE text IS NOT NULL),
p AS (SELECT id, b, CAST(octet_length(b) AS BIGINT) AS n, unnest(range(0, octet_length(b))) AS sa FROM t),
s AS MATERIALIZED (SELECT id, n, sa, row_number() OVER (PARTITION BY id ORDER BY b[sa + 1:n]) - 1 AS i, b[sa + 1:n] AS x, CAST('0x' || hex(b[sa + 1:sa + 1]) AS BIGINT) AS first,
  CAST('0x' || hex(CASE WHEN sa = 0 THEN b[n:n] ELSE b[sa:sa] END) AS BIGINT) AS bwt FROM p)"""
_LCE = "list_reduce([0, 4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1], lambda g, k: CASE WHEN g + k <= octet_length(x) AND g + k <= octet_length(y) AND x[1:g + k] = y[1:g + k] THEN g + k ELSE g END)"


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("id"), "text")


def _index(*names: str):
    def run(spark, sf_dir):
        return index.text_index(talks(spark, sf_dir), names, "id", "text")

    return run


for _name, _columns, _sql in (
    ("suffix_array", ("sa",), "SELECT id, i, sa FROM s"),
    ("inverse_suffix_array", ("isa",), "SELECT id, sa AS i, i AS isa FROM s"),
    ("phi_array", ("phi",), "SELECT id, sa AS i, coalesce(lag(sa) OVER (PARTITION BY id ORDER BY i), last(sa) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS phi FROM s"),
    ("lcp_array", ("lcp",), f"SELECT id, i, CAST(CASE WHEN y IS NULL THEN 0 ELSE {_LCE} END AS BIGINT) AS lcp FROM (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS y FROM s)"),
    ("plcp_array", ("plcp",), f"SELECT id, sa AS i, CAST(CASE WHEN y IS NULL THEN 0 ELSE {_LCE} END AS BIGINT) AS plcp FROM (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS y FROM s)"),
    ("psi_array", ("psi",), "SELECT id, i, coalesce(lead(i) OVER (PARTITION BY id ORDER BY sa), first(i) OVER (PARTITION BY id ORDER BY sa)) AS psi FROM s"),
    ("lf_array", ("lf",), "SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY bwt, i) - 1 AS lf FROM s"),
    ("bwt_columns", ("bwt", "first"), "SELECT id, i, bwt, first FROM s"),
    ("lyndon_factors", ("lyndon",), "SELECT id, sa AS i, coalesce(i < min(i) OVER (PARTITION BY id ORDER BY sa ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS lyndon FROM s"),
    ("sl_types", ("sl",), "SELECT id, sa AS i, coalesce(i < lead(i) OVER (PARTITION BY id ORDER BY sa), true) AS sl FROM s"),
):
    _run = _index(*_columns)
    _run.__name__ = _name
    query(f"{SUFFIXES} {_sql}")(_run)


@query()
def longest_previous_factor(spark, sf_dir):
    return index.text_index(texts(spark, sf_dir), ("lpf",), "doc_id", "text")


@query(f"""{SUFFIXES}, l AS (SELECT id, i, bwt, lag(bwt) OVER (PARTITION BY id ORDER BY i) AS before, lag(x) OVER (PARTITION BY id ORDER BY i) AS y, x FROM s),
v AS (SELECT id, CASE WHEN before IS DISTINCT FROM bwt THEN 1 ELSE 0 END AS new, CASE WHEN y IS NULL THEN 0 ELSE {_LCE} END AS lcp FROM l)
SELECT id, CAST(sum(new) AS BIGINT) AS bwt_runs, CAST(max(lcp) AS BIGINT) AS max_lcp, round(avg(lcp), 9) AS avg_lcp FROM v GROUP BY id""")
def bwt_statistics(spark, sf_dir):
    return index.bwt_runs(talks(spark, sf_dir), "id", "text").withColumn("avg_lcp", F.round("avg_lcp", 9))


@query()
def document_bwt_statistics(spark, sf_dir):
    return index.bwt_runs(texts(spark, sf_dir), "doc_id", "text").withColumn("avg_lcp", F.round("avg_lcp", 9))


@query()
def text_characteristics(spark, sf_dir):
    return profile.characteristics(texts(spark, sf_dir))


@query(f"""{SUFFIXES}, v AS (SELECT id, CASE WHEN y IS NULL THEN 0 ELSE {_LCE} END AS lcp FROM (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS y FROM s))
SELECT CAST(t.threshold AS BIGINT) AS threshold, count(*) AS n_entries FROM v JOIN range(1, 41) t(threshold) ON v.lcp >= t.threshold GROUP BY ALL""")
def threshold_sweep(spark, sf_dir):
    # Counted by value first (few rows), then summed up from above: no row is multiplied by the thresholds.
    from pyspark.sql import Window

    found = index.text_index(talks(spark, sf_dir), ("lcp",), "id", "text").where("lcp > 0").select(F.least("lcp", F.lit(40)).alias("v")).groupBy("v").count()
    steps = spark.range(1, 41).withColumnRenamed("id", "threshold")
    filled = steps.join(F.broadcast(found), F.col("threshold") == F.col("v"), "left").select("threshold", F.coalesce("count", F.lit(0)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("threshold")))
    return filled.select("threshold", above.alias("n_entries")).where("n_entries > 0")


_BITS = "WITH b AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS bit FROM orders)"


@query(f"{_BITS} SELECT o_custkey, o_orderkey, CAST(sum(bit) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rank1, CAST(sum(1 - bit) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rank0 FROM b")
def rank_bits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return index.rank_bits(rows, ["o_custkey"], ["o_orderkey"], (F.col("o_orderkey") % 3 == 0).cast("int"))


@query(f"{_BITS}, n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM b) SELECT o_custkey, pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM n WHERE bit = 1")
def select_bits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return index.select_bits(rows, ["o_custkey"], ["o_orderkey"], (F.col("o_orderkey") % 3 == 0).cast("int")).select("o_custkey", "pos", "k")


# Round trips of every codec over all documents.

ROUND_TRIPS = {
    "noop": "noop", "rle": "rle", "mtf": "mtf", "bwt": "bwt", "escape": "escape", "bit": "encode(bit)", "ascii": "encode(ascii)", "gamma": "encode(gamma)", "delta": "encode(delta)", "ternary": "encode(ternary)",
    "huff": "encode(huff)", "arith": "encode(arithmetic)", "sle": "encode(sle)", "bwtzip": "bwt:rle:mtf:encode(huff)", "lzss": "lzss(huff)", "lzss_lcp": "lzss_lcp(bit, threshold=5)",
    "lz78": "lz78(huff)", "lz78_reset": "lz78(bit, dict_size=512)", "lzw": "lzw(bit)", "lzw_reset": "lzw(bit, dict_size=512)", "lz78u": "lz78u(coder=huff, threshold=5, comp=buffering)",
    "lcpcomp": "lcpcomp(coder=sle, threshold=5, comp=arrays, dec=scan(25))", **{f"lcpcomp_{s}": f"lcpcomp(coder=bit, comp={s})" for s in registry.STRATEGIES if s != "arrays"},
    "repair": "repair(huff)", "esp": "esp", "esp_plain": "esp(slp_coder=plain)", **{f"esp_{d}": f"esp(slp_coder=sorted({d}))" for d in grammar.ARRAYS if d != "plain"},
    "lfs": "lfs_comp(sim_st)", "lfs2": "lfs2",
}


def _round_trip(name: str, algorithm: str):
    def run(spark, sf_dir):
        back = registry.decompress(registry.compress(F.col("text"), algorithm), algorithm)
        return texts(spark, sf_dir).select("doc_id", back.alias("b")).select("doc_id", F.octet_length("b").cast("bigint").alias("n_bytes"), F.sha2("b", 256).alias("sha256"))

    run.__name__ = f"roundtrip_{name}"
    return run


_SAME = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha256 FROM documents"
for _name, _algorithm in ROUND_TRIPS.items():
    query(_SAME)(_round_trip(_name, _algorithm))


@query(_SAME)
def roundtrip_container(spark, sf_dir):
    packed = texts(spark, sf_dir).select("doc_id", registry.unpack(registry.pack(F.col("text"), "lzw(coder=bit)")).alias("b"))
    return packed.select("doc_id", F.octet_length("b").cast("bigint").alias("n_bytes"), F.sha2("b", 256).alias("sha256"))


# Relations behind the codecs.


def _factor_statistics(data: bytes, factors: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    sizes = [f[2] for f in factors]
    return len(data), len(factors), sum(sizes), max(sizes, default=0), sum(f[1] > f[0] for f in factors)


def _factors(name: str, parse):
    def run(spark, sf_dir):
        out = {"n_bytes": "bigint", "n_factors": "bigint", "n_replaced": "bigint", "longest": "bigint", "n_forward": "bigint"}
        return profile.per_text(texts(spark, sf_dir), "doc_id", "text", out, lambda b: _factor_statistics(b, parse(b)))

    run.__name__ = f"factors_{name}"
    return run


for _name, _parse in {
    "lzss": lambda b: lz.window_factors(b), "lzss_lcp": lambda b: lz.lcp_factors(transforms.escape(b), 5), "lcpcomp": lambda b: lz.lcpcomp_factors(transforms.escape(b), 5),
}.items():
    query()(_factors(_name, _parse))


@query()
def phrase_counts(spark, sf_dir):
    out = {"lz78": "bigint", "lzw": "bigint", "lz78u": "bigint"}
    return profile.per_text(texts(spark, sf_dir), "doc_id", "text", out, lambda b: (len(lz.lz78_factors(b)), len(lz.lzw_codes(b)), len(lz.lz78u_factors(transforms.escape(b)))))


@query()
def flatten_depth(spark, sf_dir):
    out = {"n_factors": "bigint", "depth": "bigint"}

    def measure(b: bytes) -> tuple[int, int]:
        factors, depth = lz.flattened(lz.lcpcomp_factors(transforms.escape(b), 5, flatten=False))
        return len(factors), depth

    return profile.per_text(texts(spark, sf_dir), "doc_id", "text", out, measure)


@query()
def grammar_sizes(spark, sf_dir):
    out = {"repair_rules": "bigint", "repair_start": "bigint", "esp_rules": "bigint", "esp_depth": "bigint", "lfs_rules": "bigint", "lfs2_rules": "bigint", "lfs2_depth": "bigint"}

    def measure(b: bytes) -> tuple:
        start, rules = grammar.repair_grammar(b)
        _, slp = grammar.esp_grammar(b)
        one, two = grammar.lfs_grammar(b, 2, 1)[1], grammar.lfs_grammar(b, 5, 2)[1]
        return len(rules), len(start), len(slp), max(grammar.depths(slp), default=0), len(one), len(two), max(grammar.depths(two), default=0)

    return profile.per_text(texts(spark, sf_dir), "doc_id", "text", out, measure)


@query()
def factor_rows(spark, sf_dir):
    return relations.factors(texts(spark, sf_dir), "lcpcomp")


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_covered FROM documents WHERE strlen(text) > 0")
def literals_and_factors(spark, sf_dir):
    docs = texts(spark, sf_dir).where("length(text) > 0")
    sizes = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))
    found = relations.factors(docs, "lzss")
    gaps = relations.uncovered(found, sizes).select("doc_id", (F.col("end") - F.col("begin")).alias("n"))
    return gaps.union(found.select("doc_id", "len")).groupBy("doc_id").agg(F.sum("n").alias("n_covered"))


@query()
def lz78_factor_rows(spark, sf_dir):
    return relations.lz78_rows(texts(spark, sf_dir))


@query()
def lzw_code_rows(spark, sf_dir):
    return relations.lzw_rows(texts(spark, sf_dir))


@query()
def lz78u_factor_rows(spark, sf_dir):
    return relations.lz78u_rows(texts(spark, sf_dir))


@query()
def slp_rules(spark, sf_dir):
    return relations.slp_rules(texts(spark, sf_dir))


@query()
def repair_rules(spark, sf_dir):
    return relations.repair_rules(texts(spark, sf_dir))


@query()
def suffix_tree_nodes(spark, sf_dir):
    return relations.prefix_intervals(texts(spark, sf_dir), 5)


@query(f"{SUFFIXES}, v AS (SELECT id, sa, CASE WHEN y IS NULL THEN 0 ELSE {_LCE} END AS plcp FROM (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS y FROM s)), g AS (SELECT id, plcp - coalesce(lag(plcp) OVER (PARTITION BY id ORDER BY sa), -1) AS step FROM v) SELECT id, CAST(sum(step + 1) + count(*) AS BIGINT) AS n_bits FROM g GROUP BY id")
def compressed_lcp_bits(spark, sf_dir):
    # The permuted array falls by one at most from place to place, so its steps in unary take few bits.
    from pyspark.sql import Window

    found = index.text_index(talks(spark, sf_dir), ("plcp",), "id", "text")
    step = F.col("plcp") - F.coalesce(F.lag("plcp").over(Window.partitionBy("id").orderBy("i")), F.lit(-1))
    return found.select("id", step.alias("step")).groupBy("id").agg((F.sum(F.col("step") + 1) + F.count("*")).alias("n_bits"))


def _times(v: str, factor: int) -> str:
    return f"CAST((CAST({v} AS UHUGEINT) * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"


def _signed(v: str) -> str:
    return f"CAST(CASE WHEN {v} >= 9223372036854775808::UBIGINT THEN CAST({v} AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST({v} AS HUGEINT) END AS BIGINT)"


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS UBIGINT) AS v FROM orders),
a AS (SELECT *, {_times("v", 0x9E3779B97F4A7C15)} AS k, {_times("xor(v, v >> 30)", 0xBF58476D1CE4E5B9)} AS x, {_times("xor(v, v >> 33)", 0xFF51AFD7ED558CCD)} AS y FROM o),
b AS (SELECT o_orderkey, k, {_times("xor(x, x >> 27)", 0x94D049BB133111EB)} AS x, {_times("xor(y, y >> 33)", 0xC4CEB9FE1A85EC53)} AS y FROM a),
c AS (SELECT o_orderkey, k, xor(x, x >> 31) AS x, xor(y, y >> 33) AS y FROM b)
SELECT o_orderkey, {_signed("k")} AS knuth, {_signed("x")} AS vigna, {_signed("y")} AS mixer FROM c""")
def hash_functions(spark, sf_dir):
    v = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", hashes.knuth(v).alias("knuth"), hashes.vigna(v).alias("vigna"), hashes.mixer(v).alias("mixer"))


def _rolled(k: int = 8) -> str:
    out = "0::BIGINT"
    for j in range(1, k + 1):
        out = f"(({out}) * 257 + CAST('0x' || hex(b[i + {j}:i + {j}]) AS BIGINT)) % 2147483647"
    return out


@query(f"""SELECT item_id, i, {_rolled()} AS hash FROM (SELECT item_id, b, unnest(range(0, CAST(octet_length(b) - 7 AS BIGINT))) AS i
  FROM (SELECT item_id, encode(text) AS b FROM benchmark WHERE text IS NOT NULL) WHERE octet_length(b) >= 8)""")
def rolling_hashes(spark, sf_dir):
    return relations.rows_of_texts(texts(spark, sf_dir, "benchmark"), "item_id", "text", ("i", "hash"), lambda b: enumerate(hashes.rabin_karp(b, 8).tolist()))


# Comparison, generators, corpora, streams.


@query()
def compare_suite(spark, sf_dir):
    return compare.report(compare.compare(texts(spark, sf_dir)))


@query("SELECT range AS i, CAST(bit_count(range) % 2 AS BIGINT) AS bit FROM range(65536)")
def thue_morse(spark, sf_dir):
    return generators.thue_morse_rows(spark, 17)


@query("WITH RECURSIVE f AS (SELECT 1 AS n, 'b' AS w, 'a' AS v UNION ALL SELECT n + 1, v, v || w FROM f WHERE n < 24) SELECT CAST(n AS BIGINT) AS n, CAST(length(w) AS BIGINT) AS n_bytes, md5(w) AS md5 FROM f")
def fibonacci_words(spark, sf_dir):
    rows = [(n, generators.fibonacci(n)) for n in range(1, 25)]
    return spark.createDataFrame(rows, "n bigint, w binary").select("n", F.octet_length("w").cast("bigint").alias("n_bytes"), F.md5("w").alias("md5"))


@query("WITH RECURSIVE f AS (SELECT 3 AS n, '0110101101001011010' AS a, '0110101101001' AS b, '01101011010010110101101' AS c, '011010110100101101011010110101101001' AS d UNION ALL SELECT n + 1, b, c, d, d || CASE WHEN (n + 1) % 3 = 0 THEN c ELSE a END FROM f WHERE n < 19) SELECT CAST(n + 1 AS BIGINT) AS n, CAST(length(d) AS BIGINT) AS n_bytes, md5(d) AS md5 FROM f")
def run_rich_words(spark, sf_dir):
    rows = [(n, generators.run_rich(n)) for n in range(4, 21)]
    return spark.createDataFrame(rows, "n bigint, w binary").select("n", F.octet_length("w").cast("bigint").alias("n_bytes"), F.md5("w").alias("md5"))


@query()
def random_bytes(spark, sf_dir):
    return generators.random_rows(spark, 1 << 16, 7).groupBy("c").agg(F.count("*").alias("n"))


@query()
def algorithms(spark, sf_dir):
    return registry.list_algorithms(spark)


@query("SELECT doc_id, CAST(c AS BIGINT) AS cum_bytes FROM (SELECT doc_id, sum(coalesce(strlen(text), 0)) OVER (ORDER BY doc_id) AS c FROM documents) WHERE c <= 1000000")
def corpus_prefix(spark, sf_dir):
    return corpus.prefix(table(spark, sf_dir, "documents"), 1_000_000).select("doc_id", "cum_bytes")


@query("SELECT doc_id, CAST(c AS BIGINT) AS cum_bytes FROM (SELECT doc_id, sum(coalesce(strlen(text), 0)) OVER (ORDER BY md5('1:' || doc_id)) AS c FROM documents) WHERE c <= 1000000")
def crawl_sample(spark, sf_dir):
    return corpus.sample(table(spark, sf_dir, "documents"), 1_000_000).select("doc_id", "cum_bytes")


@query("SELECT link, count(*) AS n_pages FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"/([^\":]*)\"', 1))) AS link FROM pages) GROUP BY link")
def html_links(spark, sf_dir):
    return corpus.links(table(spark, sf_dir, "pages"))


@query(r"SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM pages)")
def page_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", corpus.strip_markup(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("md5"))


@query("SELECT doc_id, strlen(text) = length(text) AS is_ascii, contains(text, chr(0)) AS has_zero FROM documents")
def content_flags(spark, sf_dir):
    return corpus.content_flags(table(spark, sf_dir, "documents")).select("doc_id", "is_ascii", "has_zero")


@query("SELECT line, count(*) AS n, md5('1:' || line) AS order_key FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY line")
def dedup_lines(spark, sf_dir):
    return corpus.distinct_lines(table(spark, sf_dir, "documents"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, CAST(sum(strlen(props)) AS BIGINT) AS raw_bytes FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return event_window_blobs(spark, sf_dir).select("window_start", "event_type", "n_events", "raw_bytes")


@query()
def event_window_blobs(spark, sf_dir):
    found = windows.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "props")
    return found.select("window_start", "event_type", "n_events", "raw_bytes", F.octet_length("blob").alias("blob_bytes"), F.sha2("blob", 256).alias("blob_sha256"))
