"""Usage, counter and rate-window counts over a stream; rows later than the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, late: str) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _day(df: DataFrame, late: str) -> DataFrame:
    return _timed(df, late).withColumn("w", F.window("ts", "1 day"))


def stream_usage_daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls per UTC day, client, tool and interface."""
    return _day(events, late).groupBy("w", "client_id", "tool", "via").agg(F.count("*").alias("calls")) \
        .select(F.to_date("w.start").alias("day"), "client_id", "tool", "via", "calls")


def stream_counts_daily(counter_events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counter events per day, metric and dimension."""
    return _day(counter_events, late).groupBy("w", "metric", "dim").agg(F.count("*").alias("n")) \
        .select(F.to_date("w.start").alias("day"), "metric", "dim", "n")


def stream_window_limits(access_log: DataFrame, name: str, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Calls per key and fixed window of one limit, and whether the limit was passed."""
    return _timed(access_log.filter(F.col("name") == name), late) \
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "key").agg(F.count("*").alias("calls")) \
        .select(F.lit(name).alias("name"), "key", F.col("w.start").alias("window_start"), "calls", (F.col("calls") > limit).alias("over_limit"))
