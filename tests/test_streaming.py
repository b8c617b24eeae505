from datetime import datetime

from pathloom import streaming


def test_replies_are_scored_once(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    at = datetime(2025, 1, 1)
    spark.createDataFrame([(1, 1, "label 1", at), (2, 0, None, at)], streaming.REPLIES).write.parquet(source)
    for _ in range(2):
        streaming.write_predictions(streaming.read_replies(spark, source), out, log).awaitTermination(60)
    assert sorted((r.pair_id, r.prediction) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, -1)]
    spark.createDataFrame([(3, 1, "0", at)], streaming.REPLIES).write.mode("append").parquet(source)
    streaming.write_predictions(streaming.read_replies(spark, source), out, log).awaitTermination(60)
    assert spark.read.parquet(out).count() == 3


def test_counts_by_window(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, 1, "1", datetime(2025, 1, 1, 0, 5)), (2, 1, "1", datetime(2025, 1, 1, 0, 50)), (3, None, "1", datetime(2025, 1, 1)), (4, 0, "1", datetime(2025, 1, 1, 2))]
    spark.createDataFrame(rows, streaming.REPLIES).write.parquet(source)
    counts = streaming.outcome_counts(streaming.read_replies(spark, source))
    q = counts.writeStream.format("memory").queryName("outcomes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.window.start.hour, r.label, r.prediction, r.n) for r in spark.table("outcomes").collect())
    assert got == [(0, 1, 1, 2), (2, 0, 1, 1)]
