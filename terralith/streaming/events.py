"""Event streams with event-time bounds on state; the same functions take batch frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "10 minutes"


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", late: str = LATENESS) -> DataFrame:
    """Events without repetitions of a key within the watermark; state older than that is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, width: str = "1 hour", time: str = "ts", by: str = "event_type", late: str = LATENESS) -> DataFrame:
    """Counts and sums per window and kind, each window once it is past the watermark."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), by)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def import_landing(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Each micro-batch of landed rows goes through an import plan, whose rows are appended under the batch's number;
    a repeated batch overwrites itself."""

    def land(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
