from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonetide.operators import spatial as SP


def _case(spark, n_zones, seed, spread):
    rng = np.random.default_rng(seed)
    zones = np.concatenate([rng.uniform(0, 1, (n_zones // 2, 2)), rng.normal(0.5, spread, (n_zones - n_zones // 2, 2))])
    hot = np.tile(zones[0] + 1e-4, (100, 1))  # a third of the points at one spot
    pts = np.concatenate([rng.uniform(-0.5, 1.5, (198, 2)), hot, [[40.0, 40.0], [-7.0, 0.3]]])
    z = spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zones)], "zone_id int, lat double, lon double")
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, lat double, lon double")
    gaps = ((pts[:, None, :] - zones[None, :, :]) ** 2).sum(2)
    return p, z, {i: int(k) + 1 for i, k in enumerate(gaps.argmin(1))}


@pytest.mark.parametrize("leaf", [4, 8, 500])
@pytest.mark.parametrize("n,spread", [(55, 0.1), (400, 0.001)])
def test_nearest_zone_by_brute_force(spark, leaf, n, spread):
    p, z, want = _case(spark, n, 3, spread)
    got = {r["id"]: r["zone_id"] for r in SP.nearest_zone(p, z, leaf=leaf).collect()}
    assert got == want


def test_index_cuts_cells_only_where_zones_are_dense(spark):
    p, z, _ = _case(spark, 400, 3, 0.001)
    spots = z.select(F.col("lat").alias("_zlat"), F.col("lon").alias("_zlon"), F.struct("zone_id").alias("z"))
    box = spark.createDataFrame([(-10.0, -1.0, 60.0)], "y double, x double, side double")
    cells = SP.cell_index(spots, box).select("depth", F.size("near").alias("n")).collect()
    assert max(c["n"] for c in cells) <= SP.LEAF and len({c["depth"] for c in cells}) > 3 and len(cells) < 20 * 400


def test_many_zones_equally_near_to_one_spot(spark):
    """Zones on a circle: cells at its centre have all of them, however small they are."""
    at = [(i, float(np.cos(i / 16 * np.pi * 2)), float(np.sin(i / 16 * np.pi * 2))) for i in range(16)]
    z = spark.createDataFrame(at, "zone_id int, lat double, lon double")
    p = spark.createDataFrame([(i, a * 0.5, b * 0.5) for i, a, b in at] + [(99, 1e-3, 1e-9)], "id int, lat double, lon double")
    assert {r["id"]: r["zone_id"] for r in SP.nearest_zone(p, z).collect()} == {i: i for i in range(16)} | {99: 0}


def test_ties_go_to_the_lower_zone_and_nulls_to_none(spark):
    z = spark.createDataFrame([(2, 0.0, 1.0), (1, 0.0, -1.0), (3, None, 0.0), (4, float("nan"), 0.0), (5, 0.0, 1.0)], "zone_id int, lat double, lon double")
    rows = [(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, 0.0, float("inf")), (5, 0.0, 1.0)]
    p = spark.createDataFrame(rows, "id int, lat double, lon double").withColumn("depth", F.lit("mine"))
    found = SP.nearest_zone(p, z).collect()
    assert {r["id"]: r["zone_id"] for r in found} == {1: 1, 2: None, 3: None, 4: None, 5: 2} and {r["depth"] for r in found} == {"mine"}
    assert {r["zone_id"] for r in SP.nearest_zone(p, z.limit(0)).collect()} == {None}
    assert SP.nearest_zone(p.limit(0), z).count() == 0


def test_segments_use_start_then_end(spark):
    z = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "b", 10.0, 10.0)], "zone_id int, zone_name string, lat double, lon double")
    places = spark.createDataFrame([("p", 0.1, 0.1), ("q", 9.0, 9.0)], "place string, lat double, lon double")
    s = spark.createDataFrame([("p", "q", 1.0), ("?", "q", 2.0), ("?", "?", 3.0)], "start_point string, end_point string, est_time double")
    assert {r["est_time"]: r["zone_id"] for r in SP.segments_to_zones(s, places, z).collect()} == {1.0: 1, 2.0: 2}
