"""Structured Streaming twins of batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def robust_price_stream(ticks: DataFrame, width: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Median price by mint and tumbling window; ticks: mint, time, price. Ticks later than the watermark are dropped."""
    return ticks.withWatermark("time", late).groupBy("mint", F.window("time", width)).agg(F.median("price").alias("price"), F.count("*").alias("trades"))


def session_stream(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Events by user and session; a session ends where more than the gap passes. events: user_id, time."""
    return events.withWatermark("time", late).groupBy("user_id", F.session_window("time", gap)).agg(F.count("*").alias("events"))
