"""Batch twins of the streaming operators, so that their results can be held against SQL; the streams are tested apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.catalog import register
from dialoom.streaming.jobs import windowed_counts


@register("daily_counts", "select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n from events group by 1, 2")
def daily_counts(spark, sf_dir):
    """Tumbling windows over event time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return windowed_counts(e).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
