"""Joins that add context to zone-hour rows.

No hint forces a broadcast: calendars, weather hours and zone tables are far below Spark's
own size threshold and are broadcast because Spark measured them; when one is not small,
the same query becomes a shuffled join that adaptive execution can split on skew.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions.clock import hour_floor
from zonetide.functions.numeric import clip


def with_defaults(df: DataFrame, defaults: Mapping[str, object], fill: bool = True) -> DataFrame:
    """Add missing columns with their default; optionally replace nulls in present ones."""
    have = set(df.columns)
    cols: dict[str, Column] = {}
    for name, value in defaults.items():
        if name not in have:
            cols[name] = F.lit(value)
        elif fill:
            cols[name] = F.coalesce(F.col(name), F.lit(value))
    return df.withColumns(cols) if cols else df


def with_weather(facts: DataFrame, weather: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hourly weather onto facts by hour, the newest known value of the hour; hours without weather take neutral values."""
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("timestamp", c)))
    hourly = (weather.groupBy(hour_floor("timestamp").alias("_hour"))
              .agg(*[newest(c).alias(c) for c in S.WEATHER_DEFAULTS if c in weather.columns]))
    joined = facts.drop(*[c for c in S.WEATHER_DEFAULTS if c in weather.columns and c in facts.columns]) \
        .withColumn("_hour", hour_floor(ts)).join(hourly, "_hour", "left").drop("_hour")
    out = with_defaults(joined, S.WEATHER_DEFAULTS)
    return out.withColumn("weather_code", F.col("weather_code").cast("int"))


def with_zone_hour_values(facts: DataFrame, values: DataFrame, columns: Mapping[str, object],
                          as_of: bool = False) -> DataFrame:
    """Aligned snapshot values onto facts by (zone, hour).

    ``values`` has one row per zone and hour. With ``as_of`` the newest value at or before the
    hour is taken instead; that is a per-zone ordered pass over two tables of zone-hours.
    """
    if not as_of:
        aligned = values.select("zone_id", hour_floor("timestamp").alias("timestamp"), *columns)
        return with_defaults(facts.join(aligned, ["zone_id", "timestamp"], "left"), columns)
    from pyspark.sql import Window as W

    tagged = facts.withColumn("_fact", F.lit(1)).unionByName(
        values.select("zone_id", "timestamp", *columns).withColumn("_fact", F.lit(0)), allowMissingColumns=True)
    seen = W.partitionBy("zone_id").orderBy("timestamp", "_fact").rowsBetween(W.unboundedPreceding, 0)
    carried = tagged.withColumns({c: F.last(F.when(F.col("_fact") == 0, F.col(c)), ignorenulls=True).over(seen)
                                  for c in columns})
    return with_defaults(carried.filter(F.col("_fact") == 1).drop("_fact"), columns)


def with_latest_zone_values(facts: DataFrame, latest: DataFrame, columns: Mapping[str, object]) -> DataFrame:
    """One current value per zone onto all of its hours."""
    return with_defaults(facts.join(latest.select("zone_id", *columns), "zone_id", "left"), columns)


def zone_rainfall(zones: DataFrame, stations: DataFrame, readings: DataFrame) -> DataFrame:
    """Rainfall per zone through its station; no station means the default one, no reading 0."""
    known = stations.select("zone_name", "station_id")
    per_station = readings.groupBy("station_id").agg(F.max("value").alias("rainfall_mm"))
    return (zones.select("zone_id", "zone_name").join(known, "zone_name", "left")
            .withColumn("station_id", F.coalesce("station_id", F.lit(S.DEFAULT_RAIN_STATION)))
            .join(per_station, "station_id", "left")
            .select("zone_id", "zone_name", F.coalesce("rainfall_mm", F.lit(0.0)).alias("rainfall_mm"))
            .withColumn("is_raining", F.col("rainfall_mm") > S.RAINING_ABOVE_MM))


def baseline_ratio(rows: DataFrame, is_train: Column, value: str = "taxi_count",
                   keys: tuple[str, ...] = ("zone_id", "hour_of_day", "is_weekend"),
                   out: str = "supply_vs_zone_baseline") -> DataFrame:
    """Value over its training-period mean for the same zone, hour and day kind.

    The means come from training rows only. Combinations not seen there use the training
    mean; the ratio stays within [0, 5].
    """
    train = rows.filter(is_train)
    means = train.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    overall = train.agg(F.avg(value)).scalar()
    base = F.coalesce(F.col("_mean"), overall)
    return (rows.join(means, list(keys), "left")
            .withColumn(out, clip(F.col(value) / (base + F.lit(1.0)), 0.0, 5.0)).drop("_mean"))


def zone_types(zones: DataFrame) -> DataFrame:
    """Fill in ``zone_type`` by name where the zone table lacks it."""
    if "zone_type" in zones.columns:
        return zones
    kind = F.lit(S.DEFAULT_ZONE_TYPE)
    for name, members in S.ZONE_TYPES_BY_NAME.items():
        kind = F.when(F.col("zone_name").isin(*members), name).otherwise(kind)
    return zones.withColumn("zone_type", kind)
