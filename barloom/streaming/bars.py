"""Bars from a stream of priced events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour", symbol: str = "event_type", ts: str = "ts", price: str = "value", key: str = "event_id") -> DataFrame:
    """Tumbling bars by symbol, each emitted once the watermark has passed it; works on a batch as well.

    An event that comes twice within the lateness counts once.  ts may be without a zone: it is taken as UTC.
    """
    rows = events.select(F.col(symbol).alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), F.col(price).alias("p"), F.col(key).alias("k"))
    rows = rows.withWatermark("ts", lateness)
    rows = rows.dropDuplicatesWithinWatermark(["k"]) if events.isStreaming else rows.dropDuplicates(["k"])
    return rows.groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    ).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour", symbol: str = "event_type", ts: str = "ts", price: str = "value") -> DataFrame:
    """Sessions of activity by symbol: start, end, n and sum of the price."""
    rows = events.select(F.col(symbol).alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), F.col(price).alias("p")).withWatermark("ts", lateness)
    return rows.groupBy("symbol", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")).select("symbol", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")
