"""Event-time windows over batch or streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, size: str, by: list[str], value: str = "value", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Events and their summed value in each window and group; late: how long a stream waits for late events."""
    df = events.withWatermark(at, late) if late and events.isStreaming else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("events"), F.round(F.sum(value), 2).alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "events", "value")


def session_windows(events: DataFrame, at: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    df = events.withWatermark(at, late) if late and events.isStreaming else events
    return df.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "events")


def deduplicated(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each key once, as long as repeats come within the wait."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
