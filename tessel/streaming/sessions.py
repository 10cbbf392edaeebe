"""Extensions for streams; the segment domain itself is a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs an instant; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_signal(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and means of ``value`` by event type and tumbling window, on a stream or a batch; late rows are dropped
    after ``late`` on a stream."""
    w = F.window("ts", width)
    rows = _timed(events, late)
    return rows.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def gap_sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, stop, n): runs of a user's events without a gap."""
    rows = _timed(events, late)
    s = F.session_window("ts", gap)
    return rows.groupBy("user_id", s).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
