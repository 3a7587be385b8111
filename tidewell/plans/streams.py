"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.registry import query
from tidewell.sources.adapter import Tables
from tidewell.streaming import ingest


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", prelude=False)
def stream_event_counts(t: Tables) -> DataFrame:
    schema = t.table("events").schema
    source = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    done = ingest.run_to_end(t.spark, ingest.event_counts(source), "complete")
    return done.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
