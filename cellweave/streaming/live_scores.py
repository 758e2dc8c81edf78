"""An extension: event counts and sums kept up to date by hour, with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """window start, kind, n, total of a batch or stream of events (ts, event_type, value)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("kind"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")
