from corpuspress import session


def test_large_inputs_are_dealt_to_partitions_of_bounded_size(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "one")
    spark.range(4000).selectExpr("id", "sha2(string(id), 512) AS text").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert session.spread(df).rdd.getNumPartitions() == 16  # four to a core
    monkeypatch.setattr(session, "PART", size // 50, raising=False)
    monkeypatch.setattr(session, "SMALL", size // 50, raising=False)
    dealt = session.spread(df)
    assert 50 <= dealt.rdd.getNumPartitions() <= 51
    assert max(dealt.rdd.glom().map(len).collect()) < 200 and dealt.count() == 4000
