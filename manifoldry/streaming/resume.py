"""Incremental scoring that restarts where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def score_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, score: Callable[[DataFrame], DataFrame]) -> None:
    """Score the files in `source` that no earlier call has scored and append the results to `sink`.

    The checkpoint remembers what was read; a batch that is repeated after a failure overwrites its own part of the sink.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
