"""Nested JSON payloads to rows. Each takes a frame holding the payload column(s)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions import clock
from zonetide.functions.scoring import rain_flag
from zonetide.sources import schemas


def read_payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per payload file; a bare list of records becomes a ``value`` array first."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def coordinates(location):
    """(lat, lon) of "lat lon" text; null unless there are exactly two numbers."""
    parts = F.split(F.trim(location), r"\s+")
    two = F.size(parts) == 2
    return (F.when(two, F.get(parts, F.lit(0)).try_cast("double")), F.when(two, F.get(parts, F.lit(1)).try_cast("double")))


def carparks(payload: DataFrame) -> DataFrame:
    """Carparks with coordinates; records without a readable location are dropped."""
    r = payload.select(*[c for c in payload.columns if c != "value"], F.explode("value").alias("r"))
    lat, lon = coordinates(F.col("r.Location"))
    text = lambda name, default="": F.coalesce(F.col(f"r.{name}"), F.lit(default))
    return r.select(
        *[c for c in payload.columns if c != "value"], text("CarParkID").alias("carpark_id"), text("Area").alias("area"),
        text("Development").alias("development"), lat.alias("lat"), lon.alias("lon"),
        F.coalesce(F.col("r.AvailableLots").try_cast("int"), F.lit(0)).alias("available_lots"),
        text("LotType", "C").alias("lot_type"), text("Agency").alias("agency"),
    ).filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def travel_times(payload: DataFrame) -> DataFrame:
    """Road segments with direction and estimated minutes."""
    r = payload.select(*[c for c in payload.columns if c != "value"], F.explode("value").alias("r"))
    text = lambda name: F.coalesce(F.col(f"r.{name}"), F.lit(""))
    return r.select(
        *[c for c in payload.columns if c != "value"], text("Name").alias("expressway"),
        F.coalesce(F.col("r.Direction").try_cast("int"), F.lit(1)).alias("direction"),
        text("FarEndPoint").alias("far_endpoint"), text("StartPoint").alias("start_point"), text("EndPoint").alias("end_point"),
        F.coalesce(F.col("r.EstTime").try_cast("double"), F.lit(0.0)).alias("est_time"))


def hourly_weather(payload: DataFrame, tz: str = S.LOCAL_TIMEZONE) -> DataFrame:
    """Parallel hourly arrays to rows, local times to instants, rain flag by code."""
    h = F.arrays_zip("hourly.time", "hourly.temperature_2m", "hourly.precipitation", "hourly.weathercode", "hourly.windspeed_10m")
    rows = payload.select(F.explode(h).alias("h"))
    local = F.replace(F.col("h.time"), F.lit("T"), F.lit(" ")).try_cast("timestamp")
    return rows.select(
        clock.instant(local, tz).alias("timestamp"), F.col("h.temperature_2m").alias("temperature_c"),
        F.col("h.precipitation").alias("rainfall_mm"), F.col("h.weathercode").alias("weather_code"),
        F.col("h.windspeed_10m").alias("windspeed_kmh"), rain_flag("h.weathercode").alias("is_raining"))


def station_readings(payload: DataFrame) -> DataFrame:
    """Readings of the first item; a missing value is 0."""
    first = F.get("items", F.lit(0))
    return (payload.select(F.explode(first["readings"]).alias("r"))
            .select("r.station_id", F.coalesce("r.value", F.lit(0.0)).alias("value")))


def reading_of(readings: DataFrame, station_id: str) -> DataFrame:
    """One station's rainfall, 0.0 when it did not report; one row."""
    return readings.filter(F.col("station_id") == station_id).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("rainfall_mm"))


def from_text(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Payload text in a column to its fields; rows that do not parse drop out."""
    parsed = df.withColumn("_p", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.col("_p").isNotNull()).select(*[c for c in df.columns if c != column], "_p.*")


SCHEMAS = {"carparks": schemas.CARPARK_PAYLOAD, "travel_times": schemas.TRAVEL_PAYLOAD,
           "weather": schemas.WEATHER_PAYLOAD, "stations": schemas.STATION_PAYLOAD}
