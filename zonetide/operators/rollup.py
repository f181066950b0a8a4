"""Point and snapshot rollups.

Every rollup is one hash aggregation: Spark combines on the map side, so a zone holding a
third of all pings costs each task one row per (zone, hour) in the shuffle, not a third of
the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions.clock import hour_floor
from zonetide.functions.numeric import round_even
from zonetide.operators.quantiles import counted_quantiles, exact_quantiles

ZONE_KEYS = ("zone_id", "zone_name", "region", "zone_type")


def keys_in(df: DataFrame, names=ZONE_KEYS) -> list[str]:
    return [k for k in names if k in df.columns]


def pings_per_zone_hour(pings: DataFrame, ts: str = "timestamp", keys=ZONE_KEYS) -> DataFrame:
    """Pings per zone and hour."""
    return (pings.groupBy(*keys_in(pings, keys), hour_floor(ts).alias("timestamp"))
            .agg(F.count(F.lit(1)).alias("taxi_count")))


def pings_per_zone(pings: DataFrame, zones: DataFrame, stamp: Column, keys=ZONE_KEYS) -> DataFrame:
    """One snapshot: every zone is present, those without pings count 0."""
    counted = pings.groupBy("zone_id").agg(F.count(F.lit(1)).alias("taxi_count"))
    return zero_filled(zones.select(*keys_in(zones, keys)), counted, ["zone_id"],
                       {"taxi_count": 0}).withColumn("timestamp", stamp)


def zero_filled(zones: DataFrame, facts: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """Dimension left join: zones without facts take the fill values."""
    return zones.join(facts, on, "left").fillna(fill)


def every_zone_hour(zones: DataFrame, facts: DataFrame, span: DataFrame, fill: dict, ts: str = "timestamp") -> DataFrame:
    """A row for every zone and every hour from ``span.first`` to ``span.last`` (one row); missing facts take the fill values.

    Each zone's row unfolds to its hours, so nothing is gathered or joined on all pairs. An empty span has no rows.
    """
    ends = zones.withColumn("_span", span.select(F.struct("first", "last")).scalar())
    hours = F.sequence("_span.first", "_span.last", F.expr("interval 1 hour"))
    grid = ends.select(*zones.columns, F.explode(hours).alias(ts))
    return grid.join(facts, ["zone_id", ts], "left").fillna(fill)


def hourly_mean(snapshots: DataFrame, ts: str = "timestamp", value: str = "taxi_count",
                keys=ZONE_KEYS) -> DataFrame:
    """Mean of the snapshots in each hour, rounded half to even."""
    return (snapshots.groupBy(*keys_in(snapshots, keys), hour_floor(ts).alias("timestamp"))
            .agg(F.bround(F.avg(value), 0).cast("int").alias(value)))


def window_mean(snapshots: DataFrame, stamp: Column, value: str = "taxi_count",
                keys=ZONE_KEYS) -> DataFrame:
    """Mean over all given snapshots, one row per zone."""
    return (snapshots.groupBy(*keys_in(snapshots, keys))
            .agg(F.bround(F.avg(value), 0).cast("int").alias(value))
            .withColumn("timestamp", stamp))


def carpark_rollup(carparks: DataFrame, zones: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Free car lots and carparks per zone (and per snapshot hour when keyed by it)."""
    cars = (carparks.filter(F.col("lot_type") == "C").groupBy("zone_id", *extra_keys)
            .agg(F.sum("available_lots").alias("carpark_available_lots"),
                 F.count("carpark_id").alias("carpark_count")))
    fill = {"carpark_available_lots": 0, "carpark_count": 0}
    if extra_keys:
        return cars.fillna(fill)
    return zero_filled(zones.select("zone_id", "zone_name"), cars, ["zone_id"], fill)


def relative_to_median(df: DataFrame, value: str, out: str, floor: float = 1.0, quantiles=exact_quantiles) -> DataFrame:
    """value / max(median over all rows, floor), four decimals."""
    mid = quantiles(df, value, {"mid": 0.5}).select("mid").scalar()
    base = F.greatest(mid, F.lit(float(floor)))
    return df.withColumn(out, round_even(F.col(value).cast("double") / base))


def congestion_rollup(segments: DataFrame, zones: DataFrame) -> DataFrame:
    """Travel time per zone relative to the global median; zones without roads are neutral.

    Times are whole minutes, so their median needs few distinct values."""
    per_zone = (relative_to_median(segments, "est_time", "ratio", quantiles=counted_quantiles).groupBy("zone_id")
                .agg(round_even(F.avg("est_time")).alias("avg_est_time_min"),
                     round_even(F.avg("ratio")).alias("congestion_ratio")))
    return zero_filled(zones.select("zone_id", "zone_name"), per_zone, ["zone_id"],
                       {"congestion_ratio": S.EXTERNAL_DEFAULTS["congestion_ratio"]})
