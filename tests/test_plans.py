import pytest
from pyspark.sql import functions as F

from corpuspress.operators import grammar
from corpuspress.plans import parser, registry


def test_parser():
    assert str(parser.parse("a(b, c=d):e")) == "chain(a(b, c=d), e)"
    assert parser.parse("a:b:c") == parser.parse("chain(chain(a, b), c)")
    assert parser.parse(" lzss ( coder = bit , 'x' ) ".replace(", 'x'", "")).named[0][0] == "coder"
    for text in ("", "a(", "a)b", "a(x=1, 2)", "'s'"):
        with pytest.raises(parser.AlgorithmError):
            parser.parse(text)


@pytest.mark.parametrize("text, error", [
    ("foo", parser.UnknownAlgorithm), ("rle(x=1)", parser.UnknownOption), ("rle(1, 2)", parser.UnknownOption), ("rle(1, offset=1)", parser.UnknownOption), ("encode", parser.UnassignedArgument),
    ("rle(offset=bit(1))", parser.WrongKind), ("lzss(coder='x')", parser.WrongKind), ("rle(offset=abc)", parser.WrongKind), ("encode(foo)", parser.UnknownAlgorithm),
])
def test_errors(text, error):
    with pytest.raises(error):
        registry.codec(text)


def test_full_matrix():
    combinations = registry.combinations()
    assert len(combinations) > 400
    for a in combinations:
        c = registry.codec(a)
        for s in (b"", b"abaabbababb" * 3, b"\0\xff\xfea\0"):
            assert c.backward(c.forward(s)) == s, a


def test_nested_options_count():
    s = b"abcXabcYabcdefgh1abcdefgh2" + bytes(range(120, 0, -1)) + b"abcKabcLefMefN"
    packed = lambda a: registry.codec(a).forward(s)
    for one, other in (("lfs_comp(st(min_lrf=8))", "lfs_comp(st)"), ("lz78u(comp=buffering(huff))", "lz78u(comp=buffering(ascii))")):
        assert packed(one) != packed(other)
    assert registry.codec("lfs_comp(st(min_lrf=8))").forward(s) == registry.codec("lfs_comp(st, min_lrf=8)").forward(s)
    assert grammar.esp(s, "sorted", "succinct_greedy") == registry.codec("esp(sorted(succinct(subseq=greedy)))").forward(s) != registry.codec("esp(sorted(succinct))").forward(s)
    for a in ("lfs_comp(st(min_lrf=8))", "lz78u(comp=buffering(huff))", "lz78u(coder=huff, comp=streaming(sle))", "esp(sorted(succinct(subseq=greedy)))"):
        for t in (s, b"", b"\0\xff"):
            assert registry.codec(a).backward(registry.codec(a).forward(t)) == t
    for a in ("lfs2(exact=true)", "lfs2bst(exact=true)", "esp(sorted(diff(subseq=greedy)))"):
        with pytest.raises(parser.UnknownOption):
            registry.codec(a)


def test_option_surface():
    """Options of data structures parse to any depth and change nothing; those that can't be honoured are errors."""
    s = b"abcXabcYabcdefgh1abcdefgh2" * 4
    run = lambda a: registry.codec(a).forward(s)
    for one, other in (
        ("lz78(bit, hash(hash_function=vigna, load_factor=50))", "lz78(bit)"), ("lzw(bit, hash_plus(hash_manager=prime))", "lzw(bit)"), ("lz78(bit, rolling(hash_roller=rk, hash_prober=linear, hash_manager=pow))", "lz78(bit)"),
        ("lz78(bit, rolling_plus(wordpack))", "lz78(bit)"), ("lcpcomp(ascii, heap, QueueListBuffer)", "lcpcomp(ascii, heap)"), ("lcpcomp(ascii, heap, MultimapListBuffer(lazy=1))", "lcpcomp(ascii, heap, scan(scans=2))"),
        ("bwt(textds(isa=sparse_isa(t=5), lcp=compressed_lcp(sa=divsufsort)))", "bwt"), ("bwt(textds(compress=plain))", "bwt"), ("esp(sorted(plain, dump_json=false), dynamic_size(hash_map))", "esp"),
        ("esp(sorted(succinct(dx_coder=wavelet_tree)))", "esp(sorted(succinct))"), ("esp(sorted(range_fit(threshold=none, wt=false)))", "esp(sorted(range_fit))"), ("lfs_comp(esa(textds=textds), lfs_enocde_strat)", "lfs_comp"),
    ):
        assert run(one) == run(other) and registry.codec(one).backward(run(one)) == s, one
    for a in ("lfs_comp(sim_st, lfs_enocde_strat(bit, delta))", "lfs_comp(st, lfs_enocde_strat(ascii, ascii))", "lfs2(lfs2_lit_coder=bit, lfs2_len_coder=gamma)", "lfs2bst(5, false, huff, delta)", "lfs_comp(coder=huff)"):
        for t in (s, b"", b"\0\xffa" * 40):
            assert registry.codec(a).backward(registry.codec(a).forward(t)) == t, a
    assert len({run(f"lfs2(lfs2_lit_coder={x}, lfs2_len_coder={y})") for x in ("huff", "bit") for y in ("gamma", "delta")}) == 4
    for a, error in (
        ("bwt(textds(isa=nonsense))", parser.UnknownAlgorithm), ("bwt(textds(compress=nonsense))", parser.UnknownOption), ("lz78(bit, hash(hash_function=nonsense))", parser.UnknownAlgorithm), ("lfs2(lfs2_lit_coder=sle)", parser.WrongKind),
        ("lfs2(lfs2_len_coder=huff)", parser.WrongKind), ("esp(sorted(succinct(dx_coder=huffman)))", parser.UnknownOption), ("esp(sorted(plain, dump_json=true))", parser.UnknownOption),
    ):
        with pytest.raises(error):
            registry.codec(a)


def test_columns(spark):
    df = spark.createDataFrame([(1, "banana" * 50), (2, ""), (3, None)], "id int, t string")
    out = df.select("id", registry.pack(F.col("t"), "bwt:rle:mtf:encode(huff)").alias("p"), registry.compress(F.col("t"), "lzw").alias("r")).withColumn("back", registry.unpack(F.col("p"))).orderBy("id").collect()
    assert bytes(out[0]["back"]) == b"banana" * 50 and bytes(out[1]["back"]) == b"" and out[2]["back"] is None and out[2]["r"] is None
    assert len(out[0]["r"]) < 300
    # One Python evaluation for both directions.
    plan = df.select("id", registry.decompress(registry.compress(F.col("t"), "rle"), "rle").alias("b")).where("id = 1")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("ArrowEvalPython") == 1


def test_own_compressor():
    @registry.compressor("swap_case", by=32)
    class SwapCase:
        def __init__(self, by):
            self.by = by

        def encode(self, b):
            return bytes(c ^ self.by for c in b)

        decode = encode

    c = registry.codec("swap_case:encode(huff)")
    assert c.backward(c.forward(b"Hello")) == b"Hello"


def test_listing(spark):
    assert registry.list_algorithms(spark).where("kind = 'compressor'").count() >= 18


def test_pipes(tmp_path):
    """Standard input to standard output and back, with and without a header, and the sizes that -s prints."""
    import json
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    call = lambda data, *args: subprocess.run([sys.executable, "-m", "corpuspress", *args], input=data, capture_output=True, check=True, cwd=root)
    text = b"piped \0 through \xff and back " * 9
    packed = call(text, "-a", "lz78(huff)", "--usestdin", "--usestdout", "-s")
    stats = json.loads(packed.stderr)["stats"]
    assert packed.stdout.startswith(b"lz78(") and (int(stats["inputSize"]), int(stats["outputSize"])) == (len(text), len(packed.stdout))
    assert call(packed.stdout, "-d", "-", "-o", "-").stdout == text
    call(text, "-a", "bwt:rle", "--raw", "-", "-o", str(tmp_path / "blob"))
    assert call((tmp_path / "blob").read_bytes(), "-d", "-a", "bwt:rle", "--raw", "-").stdout == text
    assert b"corpuspress" in call(b"", "-v").stdout
