"""Streaming extension: price events as they come. The batch operators stay the measure of what is right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.files import scratch


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; events that come later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def first_wins(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(spark: SparkSession, frame: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming frame over what its source has now, into Parquet, and read that; in complete mode the last table."""
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    frame.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(out)
