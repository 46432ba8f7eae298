"""Windowed aggregates over an event stream; extras beside the keyed state operators.

All take a streaming or a batch DataFrame with ``ts`` and ``event_type``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by fixed windows."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, n) by overlapping windows."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): events of a user no further than ``gap`` apart."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def debounced(events: DataFrame, by: list[str], quiet: str) -> DataFrame:
    """Events with no newer one of the same key within the quiet time: the newest cancels the older (batch)."""
    following = F.lead("ts").over(Window.partitionBy(*by).orderBy("ts", "event_id"))
    return events.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") - F.col("ts") >= F.expr(f"interval {quiet}"))).drop("_next")
