from pyspark.sql import functions as F

from corpuspress.plans import registry
from corpuspress.operators import lz
from corpuspress.streaming import windows


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", "x"), ("2024-01-01 00:20:00", "a", "y"), ("2024-01-01 01:10:00", "a", "z"), ("2024-01-01 05:00:00", "b", "late closes the first")]
    spark.createDataFrame(rows, "ts string, k string, t string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, t string").parquet(str(tmp_path / "in"))
    out = windows.windowed(stream, "ts", "k", "t", late="10 minutes")
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["window_start"].hour: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0]["n_events"] == 2 and registry.codec("lzw(coder=bit)").backward(bytes(got[0]["blob"])) == b"x\ny"


def test_keyed_dictionary(spark, tmp_path):
    spark.createDataFrame([("k", "abababab"), ("k", "abab")], "k string, t string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t string").parquet(str(tmp_path / "in"))
    q = windows.keyed_lzw(stream, "k", "t").writeStream.format("memory").queryName("codes").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n_bytes"], r["n_codes"]) for r in spark.sql("SELECT * FROM codes").collect()] == [(12, len(lz.lzw_codes(b"abababababab")))]
