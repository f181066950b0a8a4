"""Windowed means per zone. State holds one partial mean per zone and open window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _mean(stream: DataFrame, window, value: str, late: str, ts: str, keys: tuple[str, ...]) -> DataFrame:
    return (stream.withWatermark(ts, late).groupBy(window.alias("w"), *keys)
            .agg(F.bround(F.avg(value), 0).cast("int").alias(value))
            .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), value))


def tumbling_mean(stream: DataFrame, value: str = "taxi_count", size: str = "1 hour", late: str = "15 minutes",
                  ts: str = "timestamp", keys: tuple[str, ...] = ("zone_id",)) -> DataFrame:
    """Mean per zone and hour, emitted once the hour can no longer change."""
    return _mean(stream, F.window(ts, size), value, late, ts, keys)


def sliding_mean(stream: DataFrame, value: str = "taxi_count", size: str = "1 hour", step: str = "5 minutes",
                 late: str = "15 minutes", ts: str = "timestamp", keys: tuple[str, ...] = ("zone_id",)) -> DataFrame:
    """Mean over the trailing hour, one result per five minutes."""
    return _mean(stream, F.window(ts, size, step), value, late, ts, keys)


def tumbling_counts(stream: DataFrame, size: str = "1 hour", late: str = "15 minutes", ts: str = "timestamp",
                    keys: tuple[str, ...] = ("zone_id",)) -> DataFrame:
    """Pings per zone and hour."""
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("taxi_count")).select(*keys, F.col("w.start").alias("timestamp"), "taxi_count"))
