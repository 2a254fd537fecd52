"""Streams of crawl rows: each micro-batch is merged into versioned snapshots. An extension; the batch jobs do the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merge_stream(rows: DataFrame, folder: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Write folder/v<batch id>: merge(the snapshot before, the batch's rows). A batch that is delivered again writes
    the same version again, from the same snapshot before."""

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/v{batch_id - 1}") if batch_id else None
        merge(before, batch).write.mode("overwrite").parquet(f"{folder}/v{batch_id}")

    writer = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def snapshot(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/v{batch_id}")


def deduplicated(rows: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Each key once within the watermark, for sources that deliver again."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def counts_by_window(rows: DataFrame, event_time: str, width: str, delay: str, by: str) -> DataFrame:
    """Counts by time window and a column, late rows within the delay included."""
    return rows.withWatermark(event_time, delay).groupBy(F.window(event_time, width), by).agg(F.count("*").alias("n"))
