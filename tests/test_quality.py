from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from zonetide.operators import quality as QL
from zonetide.settings import REQUIRED_COLUMNS

GOOD = dict(zone_id=1, timestamp="2024-01-01", taxi_count=10.0, weather_code=61, is_holiday=False, rainfall_mm=1.0, region="Central", zone_type="CBD")
KINDS = "zone_id int, timestamp string, taxi_count double, weather_code int, is_holiday boolean, rainfall_mm double, region string, zone_type string"


def _rows(spark, *changes):
    return spark.createDataFrame([tuple({**GOOD, **c}.values()) for c in changes], KINDS)


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"taxi_count": 0.0}, None), ({"taxi_count": 5000.0}, None), ({"rainfall_mm": 300.0}, None), ({"region": None}, None),
    ({"taxi_count": None}, "null_taxi_count"), ({"taxi_count": -1.0}, "taxi_count_out_of_range(-1.00)"), ({"taxi_count": 5000.5}, "taxi_count_out_of_range(5000.50)"),
    ({"weather_code": 42}, "invalid_weather_code(42)"), ({"zone_id": 0}, "invalid_zone_id(0)"), ({"region": "South"}, "invalid_region(South)"),
    ({"zone_type": "port"}, "invalid_zone_type(port)"), ({"rainfall_mm": 301.0}, "rainfall_mm_out_of_range(301.00)"),
    ({"is_holiday": None, "weather_code": 42}, "null_is_holiday; invalid_weather_code(42)")])
def test_row_checks(spark, change, reason):
    clean, failed = QL.validate(_rows(spark, change))
    if reason is None:
        assert clean.count() == 1 and failed.count() == 0
    else:
        assert clean.count() == 0 and failed.first()["failure_reason"] == reason


def test_good_rows_survive_bad_ones(spark):
    clean, failed = QL.validate(_rows(spark, {}, {"zone_id": -4}, {"weather_code": 0}))
    assert clean.count() == 2 and failed.count() == 1
    assert QL.reason_counts(failed).first()["reason"] == "invalid_zone_id"


def test_missing_column_fails_all(spark):
    clean, failed = QL.schema_gate(_rows(spark, {}, {}).drop("is_holiday"), REQUIRED_COLUMNS)
    assert clean.count() == 0 and {r["failure_reason"] for r in failed.collect()} == {"missing columns: ['is_holiday']"}
    clean, failed = QL.validate(_rows(spark, {}).drop("taxi_count"))
    assert clean.count() == 0 and failed.count() == 1
    empty_clean, empty_failed = QL.validate(_rows(spark, {}).limit(0))
    assert empty_clean.count() == 0 and empty_failed.count() == 0 and "failure_reason" in empty_failed.columns


def test_imputation_and_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b"), (8.0, None)], "v double, t string")
    out = QL.impute(df, df, ["v"], ["t"]).collect()
    assert [r["v"] for r in out] == [1.0, 3.0, 3.0, 8.0] and out[3]["t"] == "b"
    p = QL.profile(df, ["v"]).first()
    assert (p["total_rows"], p["nulls"], p["distinct_values"], p["null_share"]) == (4, 1, 3, 0.25)
    d = QL.describe(df, "v").first()
    assert (d["n"], d["p50"]) == (3, 3.0)


def test_mutual_information_of_independent_and_equal_columns(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("y"), (F.col("id") % 2).cast("double").alias("same"), (F.floor(F.col("id") / 2) % 2).cast("double").alias("other"))
    mi = {r["feature"]: r["mutual_information"] for r in QL.mutual_information(df, "y", ["same", "other"]).collect()}
    assert mi["same"] == pytest.approx(0.6931, abs=1e-4) and mi["other"] == 0.0
