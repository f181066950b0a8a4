"""Rollups, windows, calendar, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.functions import scoring as X
from zonetide.functions.numeric import round_even
from zonetide.operators import features as FT
from zonetide.operators import rollup as R
from zonetide.operators import scoring as SC
from zonetide.plans import proxies as P
from zonetide.plans import sql as Q
from zonetide.plans.catalogue import query
from zonetide.sources.readers import newest_snapshots

KEY = ("zone_id", "timestamp")


def snapshots(spark, folder):
    """Five-minute counts per zone."""
    e = P.events(spark, folder)
    five = F.date_trunc("hour", "ts") + F.make_interval(mins=(F.floor(F.minute("ts") / 5) * 5).cast("int"))
    return e.groupBy("zone_id", five.alias("timestamp")).agg(F.count(F.lit(1)).alias("taxi_count"))


SNAP = """snap AS (SELECT user_id % 5 + 1 AS zone_id, time_bucket(INTERVAL 5 MINUTE, ts) AS timestamp, CAST(count(*) AS BIGINT) AS taxi_count
  FROM events GROUP BY 1, 2)"""


@query("A-01 D-05", Q.with_(Q.COUNTS) + "SELECT zone_id, timestamp, taxi_count FROM zc")
def zone_hour_rollup(spark, folder):
    return P.zone_counts(spark, folder).select(*KEY, "taxi_count")


@query("A-03 U-01", Q.with_(SNAP) + """SELECT zone_id, date_trunc('hour', timestamp) AS timestamp,
  CAST(round_even(avg(taxi_count), 0) AS INTEGER) AS taxi_count FROM snap GROUP BY 1, 2""")
def zone_hour_mean_bround(spark, folder):
    return R.hourly_mean(snapshots(spark, folder), keys=("zone_id",)).select(*KEY, "taxi_count")


@query("A-04 S-04 T-03", Q.with_(SNAP) + """SELECT zone_id, CAST(round_even(avg(taxi_count), 0) AS INTEGER) AS taxi_count,
  (SELECT date_trunc('hour', max(timestamp)) FROM snap) AS timestamp
  FROM snap WHERE timestamp IN (SELECT DISTINCT timestamp FROM snap ORDER BY timestamp DESC LIMIT 12) GROUP BY zone_id""")
def snapshot_window_mean(spark, folder):
    snap = snapshots(spark, folder)
    stamp = F.date_trunc("hour", snap.agg(F.max("timestamp")).scalar())
    return R.window_mean(newest_snapshots(snap, 12), stamp, keys=("zone_id",))


@query("A-02 J-04 P-06", Q.with_(Q.DIM) + """SELECT d.zone_id, d.zone_name, CAST(coalesce(c.n, 0) AS BIGINT) AS taxi_count FROM dim d LEFT JOIN
  (SELECT user_id % 5 + 1 AS zone_id, count(*) AS n FROM events WHERE ts >= (SELECT date_trunc('hour', max(ts)) FROM events) GROUP BY 1) c
  ON c.zone_id = d.zone_id""")
def ping_snapshot_counts(spark, folder):
    e = P.events(spark, folder)
    hour = F.date_trunc("hour", e.agg(F.max("ts")).scalar())
    return R.pings_per_zone(e.filter(F.col("ts") >= hour), P.zone_dimension(spark), hour,
                            ("zone_id", "zone_name")).select("zone_id", "zone_name", "taxi_count")


_LAG_NAMES = {"taxi_lag_1h": 1, "taxi_lag_2h": 2, "taxi_lag_3h": 3, "taxi_lag_24h": 24, "taxi_lag_48h": 48, "taxi_lag_168h": 168}
_LAG_SQL = Q.with_(Q.COUNTS, Q.series("zc")) + "SELECT zone_id, timestamp, taxi_count, " + ", ".join(
    f"{Q.r(f'lag{k}')} AS {n}" for n, k in _LAG_NAMES.items()) + " FROM filled"


@query("W-01 W-02 W-03", _LAG_SQL)
def zone_lags(spark, folder):
    df = FT.supply_series(P.zone_counts(spark, folder), more=True)
    return FT.rounded(df, _LAG_NAMES).select(*KEY, "taxi_count", *_LAG_NAMES)


@query("W-01 W-02 W-03", _LAG_SQL)
def zone_lags_long_series(spark, folder):
    """The same lags for series too long for one task: chunks with copied edges."""
    df = FT.supply_series(P.zone_counts(spark, folder), more=True, segment_rows=256)
    return FT.rounded(df, _LAG_NAMES).select(*KEY, "taxi_count", *_LAG_NAMES)


_MEANS = {"taxi_rolling_3h": 3, "taxi_rolling_6h": 6, "taxi_rolling_12h": 12, "taxi_rolling_24h": 24}


@query("W-04 W-05", Q.with_(Q.COUNTS, Q.series("zc")) + "SELECT zone_id, timestamp, " + ", ".join(
    f"{Q.r(f'mean{k}')} AS {n}" for n, k in _MEANS.items()) + " FROM filled")
def zone_rolling(spark, folder):
    df = FT.supply_series(P.zone_counts(spark, folder), more=True)
    return FT.rounded(df, _MEANS).select(*KEY, *_MEANS)


@query("W-06 W-07", Q.with_(Q.COUNTS, Q.series("zc")) + f"""SELECT zone_id, timestamp, {Q.r('std3')} AS taxi_rolling_3h_std,
  {Q.r('std6')} AS taxi_rolling_6h_std, max3 AS taxi_rolling_3h_max, min3 AS taxi_rolling_3h_min, max3 - min3 AS taxi_rolling_3h_range FROM filled""")
def zone_rolling_stats(spark, folder):
    df = FT.supply_series(P.zone_counts(spark, folder), more=True)
    return FT.rounded(df, ["taxi_rolling_3h_std", "taxi_rolling_6h_std"]).select(
        *KEY, "taxi_rolling_3h_std", "taxi_rolling_6h_std", "taxi_rolling_3h_max", "taxi_rolling_3h_min", "taxi_rolling_3h_range")


_RATES = ("depletion_rate_1h", "depletion_rate_3h", "depletion_rate_6h", "supply_vs_yesterday", "taxi_abs_drop_1h")


def _rated(spark, folder):
    return FT.depletion_features(FT.supply_series(P.zone_counts(spark, folder), more=True), more=True)


@query("M-04 M-05 M-06 M-07", Q.with_(Q.COUNTS, Q.series("zc"), Q.RATES) + "SELECT zone_id, timestamp, " + ", ".join(
    f"{Q.r(c)} AS {c}" for c in _RATES) + " FROM rated")
def depletion_features(spark, folder):
    return FT.rounded(_rated(spark, folder), _RATES).select(*KEY, *_RATES)


@query("W-17", Q.with_(Q.COUNTS, Q.series("zc"), Q.RATES) + f"""SELECT zone_id, timestamp, {Q.r('mean3 - mean6')} AS supply_trend_3v6,
  {Q.r('mean6 - mean12')} AS supply_trend_6v12, {Q.r(Q.clip('depletion_rate_3h - depletion_rate_1h', '-2.0', '2.0'))} AS depletion_3v1 FROM rated""")
def supply_trend(spark, folder):
    cols = ("supply_trend_3v6", "supply_trend_6v12", "depletion_3v1")
    return FT.rounded(_rated(spark, folder), cols).select(*KEY, *cols)


@query("W-08", Q.with_(Q.COUNTS, Q.series("zc"), Q.RATES, Q.DELTA) +
       f"SELECT zone_id, timestamp, {Q.r('delta_depletion_1h')} AS delta_depletion_1h FROM deltas")
def depletion_delta(spark, folder):
    return FT.rounded(_rated(spark, folder), ["delta_depletion_1h"]).select(*KEY, "delta_depletion_1h")


@query("W-09 W-10", Q.with_(Q.DIM, Q.HOURS) + """SELECT zone_id, timestamp,
  CAST(taxi_count <= quantile_cont(taxi_count, 0.2) OVER (PARTITION BY zone_id) AS INTEGER) AS is_low_count,
  CAST(carpark_available_lots <= quantile_cont(carpark_available_lots, 0.25) OVER (PARTITION BY zone_id) AS INTEGER) AS carpark_shortage_flag FROM zh""")
def zone_percentile_flags(spark, folder):
    df = FT.supply_series(P.zone_hours(spark, folder), low_counts=True)
    return df.select(*KEY, "is_low_count", "carpark_shortage_flag")


@query("W-09 W-10", Q.with_(Q.DIM, Q.HOURS) + """SELECT zone_id, timestamp,
  CAST(taxi_count <= quantile_cont(taxi_count, 0.2) OVER (PARTITION BY zone_id) AS INTEGER) AS is_low_count,
  CAST(carpark_available_lots <= quantile_cont(carpark_available_lots, 0.25) OVER (PARTITION BY zone_id) AS INTEGER) AS carpark_shortage_flag FROM zh""")
def zone_percentile_flags_long_series(spark, folder):
    df = FT.supply_series(P.zone_hours(spark, folder), low_counts=True, segment_rows=256)
    return df.select(*KEY, "is_low_count", "carpark_shortage_flag")


@query("W-11", Q.with_(Q.COUNTS) + """SELECT zone_id, timestamp, taxi_count, coalesce(CAST(lead(taxi_count) OVER (PARTITION BY zone_id ORDER BY timestamp)
  < taxi_count * 0.6::DOUBLE AS INTEGER), 0) AS supply_shortage FROM zc""")
def next_hour_label(spark, folder):
    return FT.next_hour_label(P.zone_counts(spark, folder)).select(*KEY, "taxi_count", "supply_shortage")


_CYCLES = (("hour", "hour_of_day", 24), ("dow", "day_of_week", 7), ("month", "month", 12))


@query("D-01 D-02 D-03 D-04", Q.with_(Q.COUNTS, Q.clock("zc")) + "SELECT zone_id, timestamp, hour_of_day, day_of_week, month, is_weekend, is_peak_hour, "
       "CAST(hours_to_peak AS INTEGER) AS hours_to_peak, " + ", ".join(
           f"{Q.r(f'{f}({c} * (2.0::DOUBLE * {Q.PI}) / {p}.0::DOUBLE)')} AS {n}_{f}" for n, c, p in _CYCLES for f in ("sin", "cos")) + " FROM timed")
def time_features(spark, folder):
    df = FT.time_features(P.zone_counts(spark, folder))
    cyc = [f"{n}_{f}" for n, _, _ in _CYCLES for f in ("sin", "cos")]
    return FT.rounded(df, cyc).select(*KEY, "hour_of_day", "day_of_week", "month", "is_weekend", "is_peak_hour", "hours_to_peak", *cyc)


@query("D-06 D-07 D-08 U-04", Q.with_(Q.COUNTS, Q.clock("zc")) +
       "SELECT zone_id, timestamp, is_holiday, is_eve_holiday, is_school_holiday FROM timed")
def calendar_flags(spark, folder):
    return FT.calendar_features(P.zone_counts(spark, folder)).select(*KEY, "is_holiday", "is_eve_holiday", "is_school_holiday")


@query("M-01 M-02 M-03 M-09", Q.with_(Q.DIM, Q.HOURS, Q.series(), Q.RATES, Q.clock("rated")) + f"""SELECT zone_id, timestamp, rainfall_mm, is_raining,
  {Q.INTENSITY} AS rain_intensity, {Q.r('sqrt(rainfall_mm)')} AS rainfall_sqrt, CAST(is_raining AS INTEGER) * CAST(is_peak_hour AS INTEGER) AS rain_x_peak,
  {Q.r('rainfall_mm * greatest(depletion_rate_1h, 0.0::DOUBLE)')} AS rain_x_depletion,
  CAST(CAST(rainfall_mm * 10 AS INTEGER) % 100 IN (61, 63, 65, 67, 80, 81, 82, 95, 96, 99) AS BOOLEAN) AS rain_code
  FROM timed WHERE lag1 IS NOT NULL""")
def rain_features(spark, folder):
    df = FT.rain_interactions(P.features(spark, folder))
    code = X.rain_flag(F.rint(F.col("rainfall_mm") * 10).cast("int") % 100)
    return FT.rounded(df, ["rainfall_sqrt", "rain_x_depletion"]).select(
        *KEY, "rainfall_mm", "is_raining", "rain_intensity", "rainfall_sqrt", "rain_x_peak", "rain_x_depletion", code.alias("rain_code"))


_FEATURE_SQL = Q.with_(*Q.TO_FEATURES) + f"""SELECT zone_id, timestamp, taxi_count, hour_of_day, is_peak_hour, {Q.r('lag1')} AS taxi_lag_1h, {Q.r('lag24')} AS taxi_lag_24h,
  {Q.r('lag168')} AS taxi_lag_168h, {Q.r('mean3')} AS taxi_rolling_3h, {Q.r('mean6')} AS taxi_rolling_6h, {Q.r('depletion_rate_1h')} AS depletion_rate_1h,
  {Q.r('delta_depletion_1h')} AS delta_depletion_1h, {Q.r('taxi_abs_drop_1h')} AS taxi_abs_drop_1h, {Q.INTENSITY} AS rain_intensity, is_holiday, is_school_holiday,
  CASE zone_type WHEN 'CBD' THEN 0 WHEN 'transport_hub' THEN 1 WHEN 'residential' THEN 2 WHEN 'industrial' THEN 4 ELSE 3 END AS zone_type_encoded,
  congestion_ratio, carpark_available_lots FROM timed WHERE lag1 IS NOT NULL"""


@query("P-15 P-16 M-08 S-07", _FEATURE_SQL)
def feature_table(spark, folder):
    df = P.features(spark, folder, congestion=True)
    decimals = ["taxi_lag_1h", "taxi_lag_24h", "taxi_lag_168h", "taxi_rolling_3h", "taxi_rolling_6h", "depletion_rate_1h",
                "delta_depletion_1h", "taxi_abs_drop_1h"]
    return FT.rounded(df, decimals).select(
        *KEY, "taxi_count", "hour_of_day", "is_peak_hour", *decimals, "rain_intensity", "is_holiday", "is_school_holiday",
        "zone_type_encoded", "congestion_ratio", "carpark_available_lots")


# --- scores -----------------------------------------------------------------

@query("M-10 M-11 M-12", Q.with_(*Q.TO_SCORED) + "SELECT zone_id, timestamp, demand_pressure_score, demand_pressure_level FROM scored")
def demand_pressure(spark, folder):
    return P.scored(spark, folder).select(*KEY, "demand_pressure_score", "demand_pressure_level")


@query("M-13 M-14 M-15 M-16 M-20", Q.with_(*Q.TO_SCORED) + f"""SELECT zone_id, timestamp, baseline_supply, imbalance_score,
  {Q.level('imbalance_score')} AS imbalance_level FROM scored""")
def imbalance(spark, folder):
    return P.scored(spark, folder).select(*KEY, "baseline_supply", "imbalance_score", "imbalance_level")


@query("M-17 M-18 M-19", Q.with_(*Q.TO_SCORED) + f"""SELECT zone_id, timestamp, delay_risk_score, risk_level, predicted_shortage,
  {Q.SEVERITY} AS severity_bucket FROM scored""")
def predicted_shortage(spark, folder):
    return P.scored(spark, folder).select(*KEY, "delay_risk_score", "risk_level", "predicted_shortage",
                                          X.severity("predicted_shortage").alias("severity_bucket"))


@query("M-21", Q.with_(*Q.TO_SCORED) + f"""SELECT zone_id, timestamp, {Q.policy('intervention', 'watchlist', 'no_action')} AS policy_action,
  {Q.policy(*X.POLICY_REASONS)} AS policy_reason FROM scored""")
def policy_action(spark, folder):
    return P.scored(spark, folder).select(*KEY, "policy_action", "policy_reason")


@query("X-01", Q.with_(*Q.TO_SCORED) + "SELECT zone_id, timestamp, explanation_tag FROM scored")
def explanation_tags(spark, folder):
    return P.scored(spark, folder).select(*KEY, "explanation_tag")


@query("X-02", Q.with_(*Q.TO_SCORED) + """SELECT driver, CAST(count(*) AS BIGINT) AS rows FROM (SELECT unnest(string_split(explanation_tag, ' + ')) AS driver
  FROM scored WHERE explanation_tag <> 'normal conditions') GROUP BY 1""")
def driver_counts(spark, folder):
    tags = P.scored(spark, folder).select(F.explode(X.drivers_of("explanation_tag")).alias("driver"))
    return tags.groupBy("driver").agg(F.count(F.lit(1)).alias("rows"))


@query("P-05", Q.with_(*Q.TO_SCORED) + "SELECT zone_id, timestamp, delay_risk_score, risk_level FROM scored WHERE delay_risk_score >= 0.4")
def flagged_zones(spark, folder):
    return SC.flagged(P.scored(spark, folder)).select(*KEY, "delay_risk_score", "risk_level")


@query("A-01 W-01 W-03 W-04 M-04 M-19 P-06 L-03", Q.with_(*Q.TO_SCORED) + """SELECT zone_id, zone_name, region, timestamp, taxi_count,
  delay_risk_score, risk_level, predicted_shortage, explanation_tag FROM scored WHERE timestamp = (SELECT max(timestamp) FROM scored)""")
def ranked_current_zones(spark, folder):
    """The flagship: events to ranked zones of the newest hour."""
    now_rows = SC.latest_snapshot(P.scored(spark, folder), newest=P.newest_hour(spark, folder))
    return now_rows.select("zone_id", "zone_name", "region", "timestamp", "taxi_count", "delay_risk_score", "risk_level",
                           "predicted_shortage", "explanation_tag").orderBy(F.col("delay_risk_score").desc(), "zone_id")


@query("W-03 V-03", Q.with_(Q.COUNTS) + f"""SELECT zone_id, timestamp, {Q.r('coalesce(l1, avg(l1) OVER t)')} AS taxi_lag_1h, {Q.r('coalesce(l24, avg(l24) OVER t)')} AS taxi_lag_24h
  FROM (SELECT *, lag(taxi_count) OVER w AS l1, lag(taxi_count, 24) OVER w AS l24 FROM zc WINDOW w AS (PARTITION BY zone_id ORDER BY timestamp))
  WINDOW t AS (PARTITION BY zone_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def zone_lags_trailing(spark, folder):
    """Lags filled from earlier rows only, so no later value leaks into a feature."""
    df = FT.supply_series(P.zone_counts(spark, folder), trailing=True)
    return df.select(*KEY, round_even("taxi_lag_1h").alias("taxi_lag_1h"), round_even("taxi_lag_24h").alias("taxi_lag_24h"))
