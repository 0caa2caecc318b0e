import datetime as dt

from loamdex.operators.increment import VersionedTable
from loamdex.streaming import incremental


def test_stream_into_a_versioned_table(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "ckpt")
    schema = "k string, n int"
    spark.createDataFrame([("a", 1), ("b", 5)], schema).write.parquet(src)
    out = VersionedTable(spark, str(tmp_path / "out"), "k")

    def run():
        s = incremental.filtered(incremental.read(spark, src, schema), "n > 2", id="k").select("k", "n")
        incremental.upsert(s, out, checkpoint=at).awaitTermination()
        return sorted(map(tuple, out.read().collect()))

    assert run() == [("b", 5)]
    spark.createDataFrame([("b", 7), ("c", 9), ("d", None)], schema).write.mode("append").parquet(src)
    assert run() == [("b", 7), ("c", 9)]
    assert run() == [("b", 7), ("c", 9)]


def test_windowed_counts(spark, tmp_path):
    rows = [("a", dt.datetime(2026, 1, 1, 3, m)) for m in (1, 5, 50)] + [("b", dt.datetime(2026, 1, 1, 4))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, at timestamp").write.parquet(src)
    q = incremental.counts(incremental.read(spark, src, "k string, at timestamp"), "k", "at").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r["count"]) for r in spark.table("counts").collect()) == [("a", 3), ("b", 1)]
