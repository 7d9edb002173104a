"""Structured Streaming: tumbling bars, user bursts, and upserts of re-fetched history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cache import CacheStore, Meta


def tumbling_bars(ticks: DataFrame, width: str = "1 day", late: str = "2 days", by: str = "event_type") -> DataFrame:
    """Open, high, low, close and count of each window; a window closes when the watermark passes it."""
    if ticks.isStreaming:
        ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return (
        ticks.groupBy(F.window("ts", width).alias("w"), by)
        .agg(
            F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("n"),
        )
        .select(F.col("w.start").alias("start"), by, "open", "high", "low", "close", "n")
    )


def session_bursts(ticks: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no gap longer than this."""
    if ticks.isStreaming:
        ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = ticks.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"))
    return got.select("user_id", F.col("w.start").alias("start"), "n", "high")


def upsert_to_cache(store: CacheStore, series_id: str, meta: Meta):
    """For writeStream.foreachBatch: fresh rows win by date."""

    def upsert(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            store.merge_write(series_id, batch, meta)

    return upsert
