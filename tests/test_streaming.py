"""The answer stream: resumed runs, and repeated batches that count once."""

from datetime import datetime

from canvass.streaming import incremental

SCHEMA = "id long, ts timestamp, kind string"


def test_counts_resume(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    row = lambda i, d: (i, datetime(2024, 1, d, 5), "a")
    spark.createDataFrame([row(1, 1), row(2, 1)], SCHEMA).write.parquet(src)
    schema = spark.createDataFrame([], SCHEMA).schema

    def go():
        stream = incremental.answer_stream(spark, src, schema)
        incremental.drain(incremental.window_counts(stream, "ts", "1 day", "kind"), state, out, mode="complete")
        return sorted(r["n"] for r in spark.read.parquet(out).collect())

    assert go() == [2]
    spark.createDataFrame([row(3, 1), row(4, 2)], SCHEMA).write.mode("append").parquet(src)
    assert go() == [1, 3]


def test_answers_sent_twice_count_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    spark.createDataFrame([(1, datetime(2024, 1, 1), "a"), (1, datetime(2024, 1, 1), "a"), (2, datetime(2024, 1, 1), "b")], SCHEMA).write.parquet(src)
    stream = incremental.answer_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
    incremental.drain(incremental.once(stream, ["id"], "ts", "1 hour"), state, out)
    assert spark.read.parquet(out).count() == 2
