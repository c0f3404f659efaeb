"""Event-time windows and latest revisions over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, at: str = "ts", length: str = "1 hour", late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling counts and sums; batch and streaming alike, rows later than `late` are left out in streaming."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    out = timed.groupBy(F.window("_at", length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    out = timed.groupBy(F.session_window("_at", gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), "n")


def latest_revisions(table: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table after a batch: of each key the row with the greatest order; a late older revision changes nothing."""
    return table.unionByName(batch).groupBy(key).agg(F.max_by(F.struct(*[c for c in table.columns if c != key]), F.struct(*order)).alias("_r")).select(key, "_r.*")
