from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpuspress import queries
from corpuspress.__main__ import main
from corpuspress.functions import hashes
from corpuspress.operators import grammar, relations
from corpuspress.plans import registry
from support import SF


def test_hashes(spark):
    values = [0, 1, 2, 12345, (1 << 63) - 1, -1, -(1 << 63)]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", hashes.knuth(F.col("v")), hashes.vigna(F.col("v")), hashes.mixer(F.col("v"))).collect()
    m = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def finish(v, a, p, b, q, c):
        v = ((v ^ (v >> a)) * p) & m
        v = ((v ^ (v >> b)) * q) & m
        return signed(v ^ (v >> c))

    for r in rows:
        v = r[0] & m
        assert r[1] == signed(v * 0x9E3779B97F4A7C15 & m)
        assert r[2] == finish(v, 30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31)
        assert r[3] == finish(v, 33, 0xFF51AFD7ED558CCD, 33, 0xC4CEB9FE1A85EC53, 33)
    h = hashes.rabin_karp(b"abcabc", 3)
    assert h[0] == h[3] and len(np.unique(h)) == 3 and len(hashes.rabin_karp(b"a", 3)) == 0


def test_relations_rebuild_the_text(spark):
    df = spark.createDataFrame([(1, "abracadabra abracadabra"), (2, ""), (3, None), (4, "aaaa")], "doc_id int, text string")
    rules = relations.slp_rules(df).where("doc_id = 1").orderBy("sym").collect()
    assert grammar.expand([rules[-1]["sym"]], [(r["l"], r["r"]) for r in rules]) == b"abracadabra abracadabra"
    phrases = [b""]
    for r in relations.lz78_rows(df).where("doc_id = 4").orderBy("z").collect():
        phrases.append(phrases[r["ref"]] + bytes([r["c"]]))
    assert b"".join(phrases) == b"aaaa"
    nodes = {(r["left"], r["right"], r["depth"]) for r in relations.prefix_intervals(df).where("doc_id = 4").collect()}
    assert nodes == {(1, 4, 1), (2, 4, 2), (3, 4, 3)}
    assert relations.lzw_rows(df).where("doc_id = 2").count() == 0 and relations.lz78u_rows(df).count() > 0 and relations.corpus_pairs(df, 3).count() == 3


def test_pair_grammars_are_whole(spark):
    text = {r["doc_id"]: r["text"].encode() for r in queries.table(spark, SF, "documents").where("text IS NOT NULL").collect()}
    rules, sizes = {}, {r["doc_id"]: r for r in queries.QUERIES["grammar_sizes"](spark, SF).collect()}
    for r in queries.QUERIES["repair_rules"](spark, SF).orderBy("sym").collect():
        rules.setdefault(r["doc_id"], []).append((r["l"], r["r"]))
    assert max(len(v) for v in rules.values()) > 50 and registry.canonical(queries.ROUND_TRIPS["repair"]) == "repair(coder=huff, max_rules=0)"
    for i, data in text.items():
        start, found = grammar.repair_grammar(data)
        # No pair is left twice: occurrences that don't overlap, counted from the left.
        last, n = {}, Counter()
        for at, p in enumerate(zip(start, start[1:])):
            if at > last.get(p, -2) + 1:
                n[p], last[p] = n[p] + 1, at
        assert max(n.values(), default=0) < 2 and grammar.expand(start, rules.get(i, [])) == data
        assert rules.get(i, []) == found and (sizes[i]["repair_rules"], sizes[i]["repair_start"]) == (len(found), len(start))


def test_command_line(spark, tmp_path, capsysbinary):
    (tmp_path / "in.txt").write_bytes(b"banana" * 30)
    packed, back = str(tmp_path / "packed"), str(tmp_path / "back")
    assert main([str(tmp_path / "in.txt"), "-a", "lzw", "-o", packed, "-s"]) == 0
    assert main([packed, "-d", "-o", back]) == 0
    assert bytes(spark.read.parquet(back).first()["data"]) == b"banana" * 30
    main(["-g", "fib(5)"])
    assert capsysbinary.readouterr().out.endswith(b"abaab")
