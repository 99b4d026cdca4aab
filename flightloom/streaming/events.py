"""The windows of the batch operators over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, t: str, keys: list[str], value: str, size: str, late: str | None = None) -> DataFrame:
    """Count and sum by key and window; with `late`, a watermark lets a stream emit closed windows."""
    df = events.withWatermark(t, late) if late else events
    return df.groupBy(F.window(t, size).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*keys, F.col("_w.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, t: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Runs of events of a key with no hole of `gap`: start, end of the last event's gap, count."""
    df = events.withWatermark(t, late) if late else events
    return df.groupBy(F.session_window(t, gap).alias("_w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n")
