"""Readers and parsers, fed with files and payloads that Spark makes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.learning.splits import time_split
from zonetide.operators import scoring as SC
from zonetide.operators.enrich import zone_types
from zonetide.operators.quality import REASON
from zonetide.plans import proxies as P
from zonetide.plans import sql as Q
from zonetide.plans.catalogue import query
from zonetide.plans.queries_features import SNAP, snapshots
from zonetide.session import scratch_path, use_utc, written
from zonetide.sources import payloads as PL
from zonetide.sources import readers as R
from zonetide.sources import schemas as SCH
from zonetide.sources import writers as WR
from zonetide.sources.folders import Folder

_SOME_NAMES = ("Orchard", "Changi", "Tuas", "Bedok", "Bishan")


@query("S-01", "SELECT n_nationkey AS zone_id, CASE n_nationkey % 5 WHEN 0 THEN 'CBD' WHEN 1 THEN 'transport_hub' WHEN 2 THEN 'industrial' WHEN 4 THEN 'transport_hub' ELSE 'mixed' END AS zone_type FROM nation")
def zone_types_by_name(spark, folder):
    n = R.table(use_utc(spark), folder, "nation")
    name = F.get(F.array(*[F.lit(x) for x in _SOME_NAMES]), F.col("n_nationkey") % 5)
    return zone_types(n.select(F.col("n_nationkey").alias("zone_id"), name.alias("zone_name"))).select("zone_id", "zone_type")


@query("S-01", """SELECT n_nationkey AS zone_id, CASE n_nationkey % 5 WHEN 0 THEN 'CBD' WHEN 1 THEN 'transport_hub' WHEN 2 THEN 'industrial' WHEN 4 THEN 'transport_hub' ELSE 'mixed' END AS zone_type,
  n_nationkey / 10.0::DOUBLE AS lat, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS DOUBLE) END AS lon FROM nation""")
def zone_file_scan(spark, folder):
    """Nations written as a zone CSV without types, some without a longitude that can be read."""
    at = scratch_path(spark, "zones")
    name = F.get(F.array(*[F.lit(x) for x in _SOME_NAMES]), F.col("n_nationkey") % 5)
    lon = F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string")).otherwise("east")
    WR.write_csv(R.table(use_utc(spark), folder, "nation").select(
        F.col("n_nationkey").alias("zone_id"), name.alias("zone_name"), (F.col("n_nationkey") / 10.0).alias("lat"), lon.alias("lon")), at)
    return R.read_zones(spark, at).select(F.col("zone_id").cast("long").alias("zone_id"), "zone_type", "lat", "lon")


@query("S-02 P-01", """SELECT CAST(count(*) AS BIGINT) AS pings, min(ts) AS first_ping FROM events WHERE 1.0::DOUBLE + value / 1000.0::DOUBLE BETWEEN 1.15::DOUBLE AND 1.48::DOUBLE
  AND 103.0::DOUBLE + (user_id % 20) / 10.0::DOUBLE BETWEEN 103.60::DOUBLE AND 104.10::DOUBLE""")
def ping_file_scan(spark, folder):
    """Events written as a ping CSV with untidy headers, read back, filtered by the box."""
    at = scratch_path(spark, "pings")
    e = P.events(spark, folder)
    e.select((F.lit(1.0) + F.col("value") / F.lit(1000.0)).alias(" Latitude "), (F.lit(103.0) + (F.col("user_id") % 20) / F.lit(10.0)).alias("LONGITUDE"),
             F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("Timestamp")).write.option("header", True).csv(at)
    pings = R.read_pings(spark, at)
    return pings.agg(F.count(F.lit(1)).alias("pings"), F.min("timestamp").alias("first_ping"))


@query("S-03 U-01", Q.with_(SNAP, Q.DIM) + "SELECT zone_id, timestamp, CAST(taxi_count AS INTEGER) AS taxi_count FROM snap JOIN dim USING (zone_id)")
def snapshot_file_scan(spark, folder):
    """Five-minute snapshots written as CSV files and read back typed."""
    at = scratch_path(spark, "snapshots")
    rows = snapshots(spark, folder).join(P.zone_dimension(spark), "zone_id")
    WR.write_csv(rows.select("zone_id", "zone_name", "region", "zone_type", "taxi_count", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")), at)
    return R.read_snapshots(spark, at).select(F.col("zone_id").cast("long").alias("zone_id"), "timestamp", "taxi_count")


@query("S-05", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN date_trunc('hour', o_orderdate + INTERVAL (o_custkey % 24) HOUR + INTERVAL 30 MINUTE) - INTERVAL 8 HOUR END AS snap_ts FROM orders")
def file_name_times(spark, folder):
    o = R.table(use_utc(spark), folder, "orders")
    hour = F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0")
    name = F.when(F.col("o_orderstatus") != "P", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), hour, F.lit("-30.csv"))).otherwise("notes.csv")
    return o.select("o_orderkey", R.file_time(name).alias("snap_ts"))


@query("S-05 J-06", Q.with_("z AS (SELECT user_id % 5 + 1 AS zone_id, date_trunc('day', ts) + INTERVAL 3 HOUR AS t, CAST(count(*) AS INTEGER) AS lots FROM events GROUP BY 1, 2)")
       + "SELECT zone_id, t AS snap_ts, lots FROM z")
def timed_file_scan(spark, folder):
    """One file a day, named by its local time; a file with another name is passed over."""
    at = scratch_path(spark, "timed")
    e = P.events(spark, folder)
    moment = F.date_trunc("day", "ts") + F.expr("INTERVAL 3 HOURS")
    WR.write_timed_files(e.groupBy("zone_id", moment.alias("snap_ts")).agg(F.count(F.lit(1)).alias("lots")), at)
    Folder(spark, at).put_text("notes.csv", "zone_id,lots\n1,1\n")
    return R.read_timed_files(spark, at, schema="zone_id long, lots int").select("zone_id", "snap_ts", "lots")


@query("S-15 S-06", Q.with_(Q.RUNS) + """SELECT run_id, rows_scored, drift_flag, n AS part FROM runs, (VALUES (1), (2)) t(n) WHERE (hour(timestamp) % 2 = 0) = (n = 1)""")
def run_log_append(spark, folder):
    """The run log in two appends, stamped, read back whole."""
    at = scratch_path(spark, "runs")
    runs = P.runs(spark, folder)
    even = F.hour("timestamp") % 2 == 0
    for part, rows in ((1, runs.filter(even)), (2, runs.filter(~even))):
        WR.append_log(rows.select("run_id", "rows_scored", "drift_flag", F.lit(part).alias("part")), at, now=P.now())
    log = R.read_json_lines(spark, at, "run_id string, rows_scored long, drift_flag boolean, part int, logged_at string")
    return log.filter("logged_at IS NOT NULL").select("run_id", "rows_scored", "drift_flag", "part")


@query("S-14 P-02 P-05", Q.with_(*Q.TO_SCORED) + """SELECT 'prediction' AS sink, zone_id, timestamp, delay_risk_score AS score FROM scored
  UNION ALL SELECT 'flagged', zone_id, timestamp, delay_risk_score FROM scored WHERE delay_risk_score >= 0.4
  UNION ALL SELECT 'failed', zone_id, timestamp, NULL FROM scored WHERE taxi_count > 8""")
def run_sinks(spark, folder):
    """Predictions, flagged zones and failed rows of a run, each written by its sink, twice, and read back once."""
    at = scratch_path(spark, "sinks")
    scored = written(P.scored(spark, folder), "scored")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    failed = scored.filter("taxi_count > 8").select("zone_id", iso, F.lit("taxi_count_out_of_range").alias(REASON))
    for _ in range(2):  # a retried run replaces what it wrote
        WR.write_predictions(scored, f"{at}/predictions", "r1")
        WR.write_csv(SC.flagged(scored).select("zone_id", iso, "delay_risk_score"), f"{at}/flagged")
        WR.write_failed_rows(failed, f"{at}/failed")
    rows = lambda df, sink, score: df.select(F.lit(sink).alias("sink"), F.col("zone_id").cast("long").alias("zone_id"),
                                             F.col("timestamp").cast("timestamp").alias("timestamp"), score.cast("double").alias("score"))
    csv = lambda name: spark.read.option("header", True).csv(f"{at}/{name}")
    return (rows(R.parquet(spark, f"{at}/predictions"), "prediction", F.col("delay_risk_score")).unionByName(rows(csv("flagged"), "flagged", F.col("delay_risk_score")))
            .unionByName(rows(csv("failed").filter(F.col(REASON).isNotNull()), "failed", F.lit(None))))


@query("S-06", "SELECT event_id AS run, value AS psi FROM events WHERE event_type <> 'error'")
def tolerant_log_scan(spark, folder):
    """A JSON-lines log in which every error event left a broken line."""
    at = scratch_path(spark, "log")
    e = P.events(spark, folder)
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("run_id"), F.col("value").alias("psi")))
    e.select(F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), F.col("props"))).otherwise(good).alias("value")).write.text(at)
    return R.read_json_lines(spark, at, SCH.RUN_LOG).select(F.col("run_id").cast("long").alias("run"), "psi")


def _parsed(payloads, kind):
    """Payloads written as JSON text, one a row, and parsed by the schema of their kind."""
    return PL.from_text(payloads.select(F.to_json(F.struct("*")).alias("body")), "body", PL.SCHEMAS[kind])


@query("S-08 X-11", """SELECT CAST(event_id AS VARCHAR) AS carpark_id, 1.0::DOUBLE + (user_id % 50) / 100.0::DOUBLE AS lat, 103.5::DOUBLE AS lon, CAST(user_id % 90 AS INTEGER) AS available_lots,
  CASE WHEN event_type = 'view' THEN 'C' ELSE 'Y' END AS lot_type FROM events WHERE event_type IN ('view', 'click')""")
def carpark_payload_scan(spark, folder):
    kind = F.col("event_type")
    place = (F.when(kind.isin("view", "click"), F.concat(F.lit(" "), (F.lit(1.0) + (F.col("user_id") % 50) / F.lit(100.0)).cast("string"), F.lit("  103.5")))
             .when(kind == "error", "x y").when(kind == "purchase", ""))
    rec = F.struct(F.col("event_id").cast("string").alias("CarParkID"), F.lit("a").alias("Area"), F.lit(None).cast("string").alias("Development"), place.alias("Location"),
                   (F.col("user_id") % 90).cast("string").alias("AvailableLots"), F.when(kind != "view", "Y").alias("LotType"), F.lit("z").alias("Agency"))
    return PL.carparks(_parsed(P.events(spark, folder).select(F.array(rec).alias("value")), "carparks")).select("carpark_id", "lat", "lon", "available_lots", "lot_type")


@query("S-09", "SELECT CAST(event_id AS VARCHAR) AS expressway, CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS direction, CAST(user_id AS DOUBLE) AS est_time FROM events")
def travel_payload_scan(spark, folder):
    rec = F.struct(F.col("event_id").cast("string").alias("Name"), F.when(F.col("event_type") != "view", "2").alias("Direction"), F.lit("f").alias("FarEndPoint"),
                   F.lit("s").alias("StartPoint"), F.lit("e").alias("EndPoint"), F.col("user_id").cast("string").alias("EstTime"))
    return PL.travel_times(_parsed(P.events(spark, folder).select(F.array(rec).alias("value")), "travel_times")).select("expressway", "direction", "est_time")


_CODE = "CAST(user_id % 100 AS INTEGER)"


@query("S-10 M-03", f"""SELECT event_id, date_trunc('minute', ts) - INTERVAL 8 HOUR AS timestamp, value AS rainfall_mm, {_CODE} AS weather_code, {_CODE} IN ({Q.listed(S.RAIN_CODES)}) AS is_raining FROM events""")
def weather_payload_scan(spark, folder):
    e = P.events(spark, folder)
    code = (F.col("user_id") % 100).cast("int")
    hourly = F.struct(F.array(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("time"), F.array(F.col("event_id").cast("double")).alias("temperature_2m"),
                      F.array("value").alias("precipitation"), F.array(code).alias("weathercode"), F.array(F.lit(1.0)).alias("windspeed_10m"))
    w = PL.hourly_weather(_parsed(e.select(hourly.alias("hourly")), "weather"))
    return w.select(F.col("temperature_c").cast("long").alias("event_id"), "timestamp", "rainfall_mm", "weather_code", "is_raining")


@query("S-11", "SELECT 'S' || CAST(user_id AS VARCHAR) AS station_id, max(CASE WHEN event_type = 'error' THEN 0.0 ELSE value END) AS value FROM events GROUP BY 1")
def station_payload_scan(spark, folder):
    reading = F.struct(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("station_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    items = F.array(F.struct(F.array(reading).alias("readings")))
    return PL.station_readings(_parsed(P.events(spark, folder).select(items.alias("items")), "stations")).groupBy("station_id").agg(F.max("value").alias("value"))


@query("S-12", Q.with_(Q.COUNTS) + "SELECT zone_id, timestamp, taxi_count FROM zc WHERE taxi_count >= 3")
def feature_store_roundtrip(spark, folder):
    at = scratch_path(spark, "features")
    WR.write_table(P.zone_counts(spark, folder), at)
    return R.parquet(spark, at).filter("taxi_count >= 3").select("zone_id", "timestamp", "taxi_count")


@query("S-16 S-14", Q.with_(Q.RUNS) + "SELECT run_id, CAST(failed_rows AS BIGINT) AS failed_rows FROM runs")
def history_export(spark, folder):
    at = scratch_path(spark, "export")
    WR.export_history(P.runs(spark, folder), at)
    back = spark.read.option("header", True).csv(at)
    return back.select("run_id", F.col("failed_rows").cast("long").alias("failed_rows"))


@query("S-19", """SELECT event_id AS zone_id, CASE event_type WHEN 'view' THEN 'N/A' WHEN 'error' THEN NULL ELSE 'say "' || event_type || '"' END AS recommendation FROM events""")
def card_file_scan(spark, folder):
    """Cards whose text is "N/A", missing, or quoted."""
    at = scratch_path(spark, "cards")
    kind = F.col("event_type")
    words = F.when(kind == "view", "N/A").when(kind != "error", F.concat(F.lit('say "'), kind, F.lit('"')))
    WR.write_csv(P.events(spark, folder).select(F.col("event_id").alias("zone_id"), words.alias("recommendation")), at)
    return R.read_cards(spark, at).select(F.col("zone_id").cast("long").alias("zone_id"), "recommendation")


@query("S-20", "SELECT s_name AS zone, n_name AS neighbor FROM supplier JOIN nation ON s_nationkey % 5 = n_regionkey WHERE s_acctbal > 0")
def adjacency_scan(spark, folder):
    """Adjacency lines with null lists for some suppliers."""
    at = scratch_path(spark, "adjacency")
    names = R.table(use_utc(spark), folder, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("neighbors"))
    s = R.table(spark, folder, "supplier")
    rows = s.join(names, F.col("s_nationkey") % 5 == F.col("n_regionkey")).select(F.col("s_name").alias("zone"), F.when(F.col("s_acctbal") > 0, F.col("neighbors")).alias("neighbors"))
    rows.write.option("ignoreNullFields", False).json(at)
    return R.read_adjacency(spark, at)


@query("U-05 P-17", Q.with_(Q.COUNTS) + "SELECT zone_id, taxi_count, CAST(count(*) AS BIGINT) AS rows FROM zc GROUP BY 1, 2")
def split_and_recombined(spark, folder):
    """Train and holdout put together again, without the time column."""
    rows = time_split(P.zone_counts(spark, folder))
    both = rows.filter("is_train").unionByName(rows.filter("not is_train")).drop("timestamp", "is_train")
    return both.groupBy("zone_id", "taxi_count").agg(F.count(F.lit(1)).alias("rows"))


@query("S-13 D-06", "SELECT event_id, day(ts) % 7 = 0 AS is_holiday FROM events")
def holiday_table_join(spark, folder):
    """Every seventh day as a holiday, written as one JSON payload of records (at most one a day) and read back as a table."""
    at = scratch_path(spark, "holidays")
    e = P.events(spark, folder)
    record = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("seventh").alias("holiday_name"))
    records = F.struct(F.collect_set(F.when(F.dayofmonth("ts") % 7 == 0, record)).alias("records"))
    e.agg(F.to_json(F.struct(records.alias("result"))).alias("value")).write.text(at)
    days = R.read_holidays(spark, at).select("day", F.lit(True).alias("is_holiday"))
    return e.join(days, F.to_date("ts") == F.col("day"), "left").select("event_id", F.coalesce("is_holiday", F.lit(False)).alias("is_holiday"))
