"""Enrichment and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.functions.numeric import round_even
from zonetide.operators import decision as D
from zonetide.operators import enrich as E
from zonetide.operators import rollup as R
from zonetide.operators import spatial as SP
from zonetide.operators.features import time_features
from zonetide.plans import proxies as P
from zonetide.plans import sql as Q
from zonetide.plans.catalogue import query
from zonetide.session import use_utc
from zonetide.sources.readers import table

KEY = ("zone_id", "timestamp")


@query("J-04 A-05", """SELECT n.n_nationkey AS zone_id, n.n_name AS zone_name, CAST(coalesce(s.lots, 0) AS BIGINT) AS carpark_available_lots,
  CAST(coalesce(s.n, 0) AS BIGINT) AS carpark_count FROM nation n LEFT JOIN (SELECT s_nationkey, sum(CAST(floor(s_acctbal) AS BIGINT)) AS lots, count(*) AS n
  FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s.s_nationkey = n.n_nationkey""")
def zone_sum_zero_fill(spark, folder):
    zones = table(spark, folder, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("zone_name"))
    lots = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("carpark_id"), F.col("s_nationkey").alias("zone_id"), F.floor("s_acctbal").alias("available_lots"),
        F.when(F.col("s_acctbal") > 5000, "C").otherwise("Y").alias("lot_type"))
    return R.carpark_rollup(lots, zones)


@query("A-06", f"""SELECT p_brand AS zone, {Q.r('avg(q)')} AS congestion_ratio, {Q.r('CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / count(*)', 2)} AS avg_price FROM (
  SELECT p_brand, l_extendedprice, {Q.r('l_extendedprice / greatest((SELECT quantile_cont(l_extendedprice, 0.5) FROM lineitem), 1.0::DOUBLE)')} AS q
  FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1""")
def zone_relative_to_median(spark, folder):
    li = R.relative_to_median(table(spark, folder, "lineitem").select("l_partkey", "l_extendedprice"), "l_extendedprice", "q")
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("zone"))
    exact = F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double") / F.count(F.lit(1))
    return (li.join(part, li.l_partkey == part.p_partkey).groupBy("zone")
            .agg(round_even(F.avg("q")).alias("congestion_ratio"), round_even(exact, 2).alias("avg_price")))


@query("A-06", f"""SELECT z.i AS zone_id, 'Zone' || z.i AS zone_name, m AS avg_est_time_min, coalesce(q, 1.0) AS congestion_ratio FROM generate_series(1, 5) z(i) LEFT JOIN (
  SELECT o_custkey % 4 + 1 AS zone, {Q.r('avg(t)')} AS m, {Q.r('avg(r)')} AS q FROM (
    SELECT *, {Q.r('t / greatest((SELECT quantile_cont(CAST(o_orderkey % 61 AS DOUBLE), 0.5) FROM orders), 1.0::DOUBLE)')} AS r
    FROM (SELECT o_custkey, CAST(o_orderkey % 61 AS DOUBLE) AS t FROM orders)) GROUP BY 1) ON zone = z.i""")
def congestion_by_zone(spark, folder):
    """Orders as road segments of four zones; the fifth has no road."""
    segments = table(spark, folder, "orders").select((F.col("o_custkey") % 4 + 1).alias("zone_id"), (F.col("o_orderkey") % 61).alias("est_time"))
    return R.congestion_rollup(segments, P.zone_dimension(spark)).select("zone_id", "zone_name", "avg_est_time_min", "congestion_ratio")


WEATHER = """weather AS (SELECT date_trunc('hour', ts) AS timestamp, CAST(max(user_id) % 100 AS INTEGER) AS weather_code, max(value) AS rainfall_mm
  FROM events WHERE event_type = 'purchase' GROUP BY 1)"""


@query("J-05", Q.with_(Q.COUNTS, WEATHER) + """SELECT z.zone_id, z.timestamp, z.taxi_count, coalesce(w.weather_code, 0) AS weather_code,
  coalesce(w.rainfall_mm, 0.0) AS rainfall_mm, 28.0::DOUBLE AS temperature_c, false AS is_raining FROM zc z LEFT JOIN weather w ON w.timestamp = z.timestamp""")
def hourly_broadcast_join(spark, folder):
    e = P.events(spark, folder).filter(F.col("event_type") == "purchase")
    weather = e.groupBy(F.date_trunc("hour", "ts").alias("timestamp")).agg(
        (F.max("user_id") % 100).cast("int").alias("weather_code"), F.max("value").alias("rainfall_mm"))
    return E.with_weather(P.zone_counts(spark, folder), weather).select(
        *KEY, "taxi_count", "weather_code", "rainfall_mm", "temperature_c", "is_raining")


VIEWS = """views AS (SELECT user_id % 5 + 1 AS zone_id, date_trunc('hour', ts) AS timestamp, CAST(count(*) AS BIGINT) AS lots
  FROM events WHERE event_type = 'view' GROUP BY 1, 2)"""


def _views(spark, folder):
    return R.pings_per_zone_hour(P.events(spark, folder).filter(F.col("event_type") == "view"), "ts", ("zone_id",)).withColumnRenamed("taxi_count", "lots")


@query("J-06", Q.with_(Q.COUNTS, VIEWS) + """SELECT z.zone_id, z.timestamp, z.taxi_count, CAST(coalesce(v.lots, 0) AS BIGINT) AS lots
  FROM zc z LEFT JOIN views v USING (zone_id, timestamp)""")
def zone_hour_join(spark, folder):
    return E.with_zone_hour_values(P.zone_counts(spark, folder), _views(spark, folder), {"lots": 0}).select(*KEY, "taxi_count", "lots")


@query("J-06", Q.with_(Q.COUNTS, VIEWS) + """SELECT z.zone_id, z.timestamp, z.taxi_count, CAST(coalesce(v.lots, 0) AS BIGINT) AS lots
  FROM zc z ASOF LEFT JOIN views v ON v.zone_id = z.zone_id AND v.timestamp <= z.timestamp""")
def zone_hour_as_of_join(spark, folder):
    return E.with_zone_hour_values(P.zone_counts(spark, folder), _views(spark, folder), {"lots": 0}, as_of=True).select(*KEY, "taxi_count", "lots")


@query("J-07", Q.with_(Q.COUNTS, VIEWS) + """SELECT z.zone_id, z.timestamp, z.taxi_count, CAST(coalesce(v.lots, 0) AS BIGINT) AS lots FROM zc z LEFT JOIN
  (SELECT least(zone_id, 4) AS zone_id, arg_max(lots, {'t': timestamp, 'n': lots}) AS lots FROM views GROUP BY 1) v ON v.zone_id = z.zone_id""")
def latest_zone_join(spark, folder):
    # Views of the fifth zone count for the fourth, so one zone has no value.
    latest = _views(spark, folder).groupBy(F.least("zone_id", F.lit(4)).alias("zone_id")).agg(F.max_by("lots", F.struct("timestamp", "lots")).alias("lots"))
    return E.with_latest_zone_values(P.zone_counts(spark, folder), latest, {"lots": 0}).select(*KEY, "taxi_count", "lots")


@query("J-08", """SELECT n.n_nationkey AS zone_id, n.n_name AS zone_name, coalesce(r.v, 0.0) AS rainfall_mm, coalesce(r.v, 0.0) > 0.1 AS is_raining
  FROM nation n LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) k ON k.n_nationkey = n.n_nationkey
  LEFT JOIN (SELECT 'S' || CAST(user_id % 30 AS VARCHAR) AS station, max(value) AS v FROM events WHERE event_type = 'error' GROUP BY 1) r
  ON r.station = coalesce('S' || CAST(k.n_regionkey * 7 + 1 AS VARCHAR), 'S24')""")
def lookup_with_default(spark, folder):
    nation = table(spark, folder, "nation")
    zones = nation.select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("zone_name"))
    # Nations of the last two regions have no station of their own.
    own = F.when(F.col("n_regionkey") < 3, F.concat(F.lit("S"), (F.col("n_regionkey") * 7 + 1).cast("string")))
    stations = nation.select(F.col("n_name").alias("zone_name"), own.alias("station_id"))
    e = P.events(spark, folder).filter(F.col("event_type") == "error")
    readings = e.select(F.concat(F.lit("S"), (F.col("user_id") % 30).cast("string")).alias("station_id"), "value")
    return E.zone_rainfall(zones, stations, readings)


POINTS = """pts AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon FROM embeddings),
cen AS (SELECT label AS zone_id, round_even(avg(lat) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE AS lat, round_even(avg(lon) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE AS lon FROM pts GROUP BY 1)"""
_NEAREST = Q.with_(POINTS) + """SELECT p.vec_id, arg_min(c.zone_id, {'d': (p.lat - c.lat) * (p.lat - c.lat) + (p.lon - c.lon) * (p.lon - c.lon), 'z': c.zone_id}) AS zone_id
  FROM pts p CROSS JOIN cen c GROUP BY 1"""


def _points(spark, folder):
    v = table(use_utc(spark), folder, "embeddings")
    pts = v.select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("lat"), F.get("embedding", F.lit(1)).cast("double").alias("lon"))
    centres = pts.groupBy(F.col("label").alias("zone_id")).agg(round_even(F.avg("lat"), 6).alias("lat"), round_even(F.avg("lon"), 6).alias("lon"))
    return pts, centres


@query("J-01 J-02", _NEAREST)
def nearest_centroid(spark, folder):
    pts, centres = _points(spark, folder)
    return SP.nearest_zone(pts, centres).select("vec_id", "zone_id")


@query("J-01 J-02", _NEAREST)
def nearest_centroid_by_grid(spark, folder):
    """The same with cells cut as far as they can be, as where zones are dense."""
    pts, centres = _points(spark, folder)
    return SP.nearest_zone(pts, centres, leaf=4).select("vec_id", "zone_id")


@query("J-03", Q.with_(POINTS) + """SELECT s.o_orderkey, arg_min(c.zone_id, {'d': (p.lat - c.lat) * (p.lat - c.lat) + (p.lon - c.lon) * (p.lon - c.lon), 'z': c.zone_id}) AS zone_id
  FROM (SELECT o_orderkey, coalesce(a.vec_id, b.vec_id) AS at FROM orders LEFT JOIN pts a ON a.vec_id = o_custkey LEFT JOIN pts b ON b.vec_id = o_orderkey % 1000) s
  JOIN pts p ON p.vec_id = s.at CROSS JOIN cen c GROUP BY 1""")
def segments_to_zones(spark, folder):
    pts, centres = _points(spark, folder)
    segments = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("start_point"), (F.col("o_orderkey") % 1000).alias("end_point"))
    places = pts.select(F.col("vec_id").alias("place"), "lat", "lon")
    return SP.segments_to_zones(segments, places, centres.withColumn("zone_name", F.col("zone_id").cast("string"))).select("o_orderkey", "zone_id")


@query("P-01", Q.with_(POINTS) + "SELECT vec_id FROM pts WHERE lat BETWEEN -0.1::DOUBLE AND 0.1::DOUBLE AND lon BETWEEN 0.0::DOUBLE AND 0.2::DOUBLE")
def points_in_box(spark, folder):
    pts, _ = _points(spark, folder)
    return SP.in_box(pts, lat_range=(-0.1, 0.1), lon_range=(0.0, 0.2)).select("vec_id")


_SPARE = "greatest(taxi_count - greatest(greatest(baseline_supply, 1.0::DOUBLE) * 0.8::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) / greatest(baseline_supply, 1.0::DOUBLE)"


@query("J-09 N-04", Q.with_(*Q.TO_SCORED, Q.RING) + f"""SELECT r.zone, {Q.r('sum(' + _SPARE + ')')} AS neighbor_surplus FROM ring r JOIN
  (SELECT zone_name, arg_max(taxi_count, timestamp) AS taxi_count, arg_max(baseline_supply, timestamp) AS baseline_supply FROM scored GROUP BY 1) s
  ON s.zone_name = r.neighbor GROUP BY 1""")
def neighbor_surplus(spark, folder):
    return D.neighbor_surplus(P.ring(spark), D.zone_snapshot(P.scored(spark, folder)))


@query("J-09 N-04", """SELECT a.n_name AS zone, """ + Q.r(f"sum({_SPARE})") + """ AS neighbor_surplus FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
  JOIN (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS taxi_count, CAST(max(c_custkey) % 70 + 20 AS DOUBLE) AS baseline_supply FROM customer GROUP BY 1) s
  ON s.c_nationkey = b.n_nationkey GROUP BY 1""")
def nation_neighbor_surplus(spark, folder):
    n = table(spark, folder, "nation")
    a, b = n.alias("a"), n.alias("b")
    edges = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(
        F.col("a.n_name").alias("zone"), F.col("b.n_name").alias("neighbor"))
    held = table(spark, folder, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("taxi_count"), (F.max("c_custkey") % 70 + 20).cast("double").alias("baseline_supply"))
    snapshot = held.join(n, held.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("neighbor"), "taxi_count", "baseline_supply")
    return D.neighbor_surplus(edges, snapshot)


@query("J-11", Q.with_(Q.COUNTS, Q.clock("zc")) + f"""SELECT t.zone_id, t.timestamp, t.taxi_count,
  {Q.r(Q.clip('t.taxi_count / (coalesce(b.m, (SELECT avg(taxi_count) FROM timed WHERE timestamp < TIMESTAMP ' + "'2024-01-20')" + ') + 1.0::DOUBLE)', '0.0', '5.0'))} AS supply_vs_zone_baseline
  FROM timed t LEFT JOIN (SELECT zone_id, hour_of_day, is_weekend, avg(taxi_count) AS m FROM timed WHERE timestamp < TIMESTAMP '2024-01-20' GROUP BY 1, 2, 3) b
  USING (zone_id, hour_of_day, is_weekend)""")
def train_only_baseline(spark, folder):
    rows = time_features(P.zone_counts(spark, folder))
    out = E.baseline_ratio(rows, F.col("timestamp") < F.lit("2024-01-20").cast("timestamp"))
    return out.select(*KEY, "taxi_count", round_even("supply_vs_zone_baseline").alias("supply_vs_zone_baseline"))


@query("J-16 P-14", """SELECT n.n_nationkey AS zone_id, coalesce(nullif(trim(coalesce(x.name, '')), ''), CAST(n.n_nationkey AS VARCHAR)) AS zone_name
  FROM nation n LEFT JOIN (SELECT s_nationkey, min(CASE WHEN s_suppkey % 7 = 0 THEN '  ' ELSE s_name END) AS name FROM supplier GROUP BY 1) x ON x.s_nationkey = n.n_nationkey""")
def zone_names_with_fallback(spark, folder):
    from zonetide.functions.numeric import label_of

    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("zone_id"))
    # Every seventh supplier has a blank for a name; a blank comes first, so its nation falls back to the number.
    name = F.when(F.col("s_suppkey") % 7 == 0, "  ").otherwise(F.col("s_name"))
    names = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("zone_id")).agg(F.min(name).alias("name"))
    named = n.join(names, "zone_id", "left")
    clean = label_of("name", "")
    return named.select("zone_id", F.when(clean == "", F.col("zone_id").cast("string")).otherwise(clean).alias("zone_name"))
