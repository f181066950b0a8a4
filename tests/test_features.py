from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from conftest import hours
from pyspark.sql import functions as F

from zonetide.operators import enrich as E
from zonetide.operators import features as FT
from zonetide.operators import rollup as R
from zonetide.operators.segments import numbered, ranged, run_lengths
from zonetide.settings import EXTERNAL_DEFAULTS


def _random_zones(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    series = {z: [int(x) if rng.random() > 0.1 else None for x in rng.integers(0, 150, n)] for z in (1, 2)}
    series[3] = [7]
    return hours(spark, series), series


def test_series_against_pandas(spark):
    df, series = _random_zones(spark)
    got = FT.depletion_features(FT.supply_series(df, more=True, low_counts=True)).toPandas().sort_values(["zone_id", "timestamp"])
    for zone in (1, 2):
        c = pd.Series([v for v in series[zone] if v is not None], dtype=float)
        mine = got[got.zone_id == zone].reset_index(drop=True)
        for name, k in {**FT.LAGS, **FT.MORE_LAGS}.items():
            lag = c.shift(k)
            np.testing.assert_allclose(mine[name], lag.fillna(lag.mean()), rtol=1e-12)
        for name, k in {**FT.MEANS, **FT.MORE_MEANS}.items():
            np.testing.assert_allclose(mine[name], c.shift(1).rolling(k, min_periods=1).mean().fillna(c.mean()), rtol=1e-9)
        np.testing.assert_allclose(mine["taxi_rolling_6h_std"], c.shift(1).rolling(6, min_periods=2).std().fillna(0), atol=1e-9)
        np.testing.assert_array_equal(mine["is_low_count"], (c <= c.quantile(0.2)).astype(int))
        lag1 = c.shift(1).fillna(c.shift(1).mean())
        rate = ((lag1 - c) / (lag1 + 1)).clip(-2, 2)
        np.testing.assert_allclose(mine["depletion_rate_1h"], rate, rtol=1e-9)
        np.testing.assert_allclose(mine["delta_depletion_1h"], (rate - rate.shift(1)).fillna(0).clip(-2, 2), atol=1e-9)


@pytest.mark.parametrize("rows", [168, 200, 1000])
def test_chunked_series_equal_plain_ones(spark, rows):
    df, _ = _random_zones(spark)
    cols = ["zone_id", "timestamp", *FT.LAGS, *FT.MEANS, "taxi_rolling_3h_std", "is_low_count", "_depletion_before"]
    plain = FT.supply_series(df, more=True, low_counts=True).select(cols).toPandas().sort_values(["zone_id", "timestamp"]).reset_index(drop=True)
    cut = FT.supply_series(df, more=True, low_counts=True, segment_rows=rows).select(cols).toPandas().sort_values(["zone_id", "timestamp"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, cut, rtol=1e-9)


def test_build_features_columns_and_single_row_zone(spark):
    df, _ = _random_zones(spark, 60)
    out = FT.build_features(df)
    assert set(FT.model_columns(out)) >= {"hour_sin", "taxi_lag_168h", "is_low_count", "zone_type_encoded", "is_school_holiday", "carpark_shortage_flag"}
    assert out.filter("zone_id = 3").count() == 0
    bad = out.filter((F.abs(F.col("hour_sin") ** 2 + F.col("hour_cos") ** 2 - 1) > 1e-9) | (F.col("supply_vs_yesterday") > 5)
                     | (F.abs("depletion_rate_1h") > 2) | (F.abs("taxi_abs_drop_1h") > 200)).count()
    assert bad == 0
    assert {k: out.select(k).first()[0] for k in ("temperature_c", "congestion_ratio")} == {k: EXTERNAL_DEFAULTS[k] for k in ("temperature_c", "congestion_ratio")}
    assert out.agg(F.max("carpark_shortage_flag")).first()[0] == 0
    assert FT.model_input(out).filter(" or ".join(f"{c} is null" for c in FT.model_columns(out))).count() == 0


@pytest.mark.parametrize("now,then,label", [(100, 50, 1), (100, 70, 0), (100, 60, 0), (100, 59, 1)])
def test_next_hour_label(spark, now, then, label):
    df = hours(spark, {1: [now, then]})
    rows = FT.next_hour_label(df).orderBy("timestamp").collect()
    assert [r["supply_shortage"] for r in rows] == [label, 0]
    assert FT.next_hour_label(df, drop_last=True).count() == 1


def test_local_time_fields(spark):
    df = hours(spark, {1: [1]}, "2024-01-05 16:00:00")  # Saturday midnight in local time
    r = FT.time_features(df).first()
    assert (r["hour_of_day"], r["day_of_week"], r["is_weekend"], r["is_peak_hour"]) == (0, 5, True, False)


def test_hourly_mean_rounds_half_to_even(spark):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", c) for m, c in ((0, 2), (5, 3))] + [(1, f"2024-01-01 01:{m:02d}:00", c) for m, c in ((0, 3), (5, 4))]
    df = spark.createDataFrame(rows, "zone_id int, t string, taxi_count int").withColumn("timestamp", F.col("t").cast("timestamp"))
    got = [r["taxi_count"] for r in R.hourly_mean(df).orderBy("timestamp").collect()]
    assert got == [2, 4]


def test_snapshot_keeps_every_zone(spark):
    zones = spark.createDataFrame([(1, "a"), (2, "b")], "zone_id int, zone_name string")
    none = spark.createDataFrame([], "zone_id int")
    out = R.pings_per_zone(none, zones, F.lit("2024-01-01").cast("timestamp")).orderBy("zone_id").collect()
    assert [(r["zone_id"], r["taxi_count"]) for r in out] == [(1, 0), (2, 0)]


def test_carpark_and_congestion_rollups(spark):
    zones = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "zone_id int, zone_name string")
    lots = spark.createDataFrame([(1, "p", 10, "C"), (1, "q", 5, "C"), (1, "r", 99, "Y"), (2, "s", 1, "H")], "zone_id int, carpark_id string, available_lots int, lot_type string")
    got = {r["zone_id"]: (r["carpark_available_lots"], r["carpark_count"]) for r in R.carpark_rollup(lots, zones).collect()}
    assert got == {1: (15, 2), 2: (0, 0), 3: (0, 0)}
    roads = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 8.0)], "zone_id int, est_time double")
    ratio = {r["zone_id"]: r["congestion_ratio"] for r in R.congestion_rollup(roads, zones).collect()}
    assert ratio == {1: 0.75, 2: 2.0, 3: 1.0}


def test_weather_defaults_and_rain_lookup(spark):
    df = hours(spark, {1: [5, 6]})
    weather = df.limit(0).select("timestamp").withColumns({"rainfall_mm": F.lit(1.0), "weather_code": F.lit(61)})
    out = E.with_weather(df, weather).collect()
    assert all(r["temperature_c"] == 28.0 and r["weather_code"] == 0 and r["is_raining"] is False for r in out)
    zones = spark.createDataFrame([(1, "a"), (2, "b")], "zone_id int, zone_name string")
    stations = spark.createDataFrame([("a", "S1")], "zone_name string, station_id string")
    readings = spark.createDataFrame([("S1", 0.1), ("S24", 3.0)], "station_id string, value double")
    got = {r["zone_id"]: (r["rainfall_mm"], r["is_raining"]) for r in E.zone_rainfall(zones, stations, readings).collect()}
    assert got == {1: (0.1, False), 2: (3.0, True)}


def _runs(flags):
    run, out = 0, []
    for f in flags:
        run = run + 1 if f else 0
        out.append(run)
    return out


def test_run_lengths_over_ranges(spark):
    rng = np.random.default_rng(2)
    flags = {z: [int(x) for x in (rng.random(200) < p)] for z, p in ((1, 0.9), (2, 0.5), (3, 1.1))}
    df = hours(spark, flags, value="hit")
    out = run_lengths(df, ["zone_id"], "timestamp", "hit", rows=40, fresh="fresh").toPandas().sort_values(["zone_id", "timestamp"])
    for z, fs in flags.items():
        mine = out[out.zone_id == z]
        assert mine["run_length"].tolist() == _runs(fs)
        assert mine["fresh"].tolist() == [all(fs[:i + 1]) for i in range(len(fs))]


def test_a_zone_with_most_rows_of_one_day_is_cut(spark):
    """Nine rows in ten are one zone's, within a day, several of them at one moment."""
    rng = random.Random(9)
    rows = [(1, i // 3, int(rng.random() < 0.8)) for i in range(900)] + [(z, i, int(rng.random() < 0.8)) for z in (2, 3) for i in range(50)]
    df = spark.createDataFrame(rows, "zone_id long, second int, hit int").withColumn(
        "timestamp", F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("second"))).drop("second")
    cut = ranged(df, ["zone_id", "timestamp"], 100)
    sizes = {r["_range"]: r["count"] for r in cut.groupBy("_range").count().collect()}
    assert len(sizes) == 10 and max(sizes.values()) < 250 and cut.filter("zone_id = 1").select("_range").distinct().count() >= 8
    for rows_ in (100, 250_000):
        out = run_lengths(df, ["zone_id"], "timestamp", "hit", rows=rows_).collect()
        for z in (1, 2, 3):
            mine = sorted((r["timestamp"], -r["hit"], r["run_length"]) for r in out if r["zone_id"] == z)
            assert [m[2] for m in mine] == _runs([-m[1] for m in mine])
    pos = numbered(df, ["zone_id"], "timestamp", ["hit"], rows=100)
    assert {z: sorted(r["_pos"] for r in pos.filter(F.col("zone_id") == z).collect()) for z in (1, 2)} == {1: list(range(1, 901)), 2: list(range(1, 51))}
