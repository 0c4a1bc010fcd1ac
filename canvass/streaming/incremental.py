"""Scores that follow arriving answers: counts in a stream, distances from the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def answer_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    """Answers from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first answer of each key within a delay; a batch that is sent again counts once."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, time: str, width: str, *keys: str, delay: str | None = None) -> DataFrame:
    """Counts in tumbling windows; with a delay, windows close and late answers are dropped."""
    timed = stream.withWatermark(time, delay) if delay else stream
    return timed.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def drain(result: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Run over what there is and stop; a checkpoint lets the next run go on from there."""
    writer = result.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer.format("parquet").option("path", out).outputMode("append").start().awaitTermination()
        return

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer.outputMode(mode).foreachBatch(replace).start().awaitTermination()
