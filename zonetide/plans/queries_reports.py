"""Operational views, alerts, versions, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions import clock
from zonetide.functions import text as T
from zonetide.functions.numeric import safe_int
from zonetide.operators import drift as DR
from zonetide.operators import reports as RP
from zonetide.operators import scoring as SC
from zonetide.operators import versions as V
from zonetide.plans import proxies as P
from zonetide.plans import sql as Q
from zonetide.plans.catalogue import query
from zonetide.plans.queries_decisions import _TO_CARDS, card_rows
from zonetide.session import scratch_path, use_utc, written
from zonetide.sources import writers as WR
from zonetide.sources.payloads import from_text
from zonetide.sources.readers import table
from zonetide.sources.writers import json_text


def _now_rows(spark, folder):
    return SC.latest_snapshot(P.scored(spark, folder), newest=P.newest_hour(spark, folder))


def _event_drift(spark, folder):
    """Drift of the events' values between the halves of the month."""
    e = P.events(spark, folder).select("ts", "value")
    mid = F.lit("2024-01-16").cast("timestamp")
    return DR.score_drift(e.filter(F.col("ts") < mid), e.filter(F.col("ts") >= mid), "value")


_DRIFT = """et AS (SELECT value AS v, ts >= TIMESTAMP '2024-01-16' AS cur FROM events WHERE value IS NOT NULL), es AS (SELECT min(v) AS lo, (max(v) - min(v)) / 10.0::DOUBLE AS step FROM et),
eg AS (SELECT v, cur, lo, step, least(floor((v - lo) / step), 9) AS g FROM et, es), ed AS (SELECT *, g - CASE WHEN v < lo + g * step THEN 1 ELSE 0 END AS d FROM eg),
ec AS (SELECT d + CASE WHEN d < 9 AND v >= lo + (d + 1) * step THEN 1 ELSE 0 END AS bin, count(*) FILTER (WHERE NOT cur) AS c0, count(*) FILTER (WHERE cur) AS c1 FROM ed GROUP BY 1),
drift AS (SELECT greatest(sum((a - e) * ln(a / e)), 0.0::DOUBLE) AS psi FROM (SELECT greatest(c0 / sum(c0) OVER (), 1e-6::DOUBLE) AS e, greatest(c1 / sum(c1) OVER (), 1e-6::DOUBLE) AS a FROM ec))"""
_LATEST = "now_rows AS (SELECT * FROM scored WHERE timestamp = (SELECT max(timestamp) FROM scored))"


@query("A-08", Q.with_(*Q.TO_SCORED, _LATEST) + f"""SELECT CAST(count(*) AS BIGINT) AS rows_scored, {Q.count_if('delay_risk_score >= 0.4')} AS flagged_zones,
  {Q.r('1.0::DOUBLE - avg(CASE WHEN delay_risk_score >= 0.7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS fulfilment_rate,
  {Q.r('avg(least(greatest(depletion_rate_1h, 0.0::DOUBLE), 1.0::DOUBLE)) FILTER (WHERE delay_risk_score >= 0.4) * 20.0::DOUBLE', 2)} AS avg_delay_min, CAST(sum(taxi_count) AS BIGINT) AS total_taxi_count,
  (SELECT {Q.count_if('delay_risk_score >= 0.7')} FROM now_rows) AS high_risk_zones_now, (SELECT CAST(sum(taxi_count) AS BIGINT) FROM now_rows) AS supply_now,
  (SELECT {Q.count_if('depletion_rate_1h > 0.3')} FROM now_rows) AS rapid_depletion_zones, {Q.r('avg(demand_pressure_score)')} AS avg_demand_pressure_score, {Q.r('avg(imbalance_score)')} AS avg_imbalance_score FROM scored""")
def run_kpis(spark, folder):
    return SC.run_kpis(P.scored(spark, folder), latest=P.newest_hour(spark, folder))


@query("A-09 D-09", Q.with_(*_TO_CARDS, _LATEST, _DRIFT) + f"""SELECT {Q.count_if("risk_level = 'high'")} AS high_risk_zone_count, {Q.count_if("risk_level = 'medium'")} AS medium_risk_zone_count,
  CAST(sum(taxi_count) AS BIGINT) AS total_taxi_supply, {Q.count_if('depletion_rate_1h > 0.3')} AS rapid_depletion_zones,
  (SELECT {Q.count_if("priority IN ('critical', 'high')")} FROM card) AS critical_actions_count, (SELECT {Q.r('psi')} FROM drift) AS model_psi,
  (SELECT CAST(date_diff('minute', date_trunc('minute', max(ts)), {Q.NOW_SQL}) AS BIGINT) FROM events) AS minutes_since_last_run FROM now_rows""")
def overview_kpis(spark, folder):
    last = F.date_trunc("minute", P.events(spark, folder).agg(F.max("ts")).scalar())
    return SC.overview_kpis(_now_rows(spark, folder), card_rows(spark, folder), _event_drift(spark, folder).select("psi").scalar(), clock.minutes_since(last, P.now()))


@query("A-10", Q.with_(*Q.TO_SCORED, _LATEST) + f"""SELECT *, {Q.r(f"{Q.r('high / zones', 6)} * 100.0::DOUBLE", 1)} AS high_pct, {Q.r(f"{Q.r('medium / zones', 6)} * 100.0::DOUBLE", 1)} AS medium_pct,
  {Q.r(f"{Q.r('low / zones', 6)} * 100.0::DOUBLE", 1)} AS low_pct FROM (SELECT CAST(count(*) AS BIGINT) AS zones, {Q.count_if("risk_level = 'high'")} AS high, {Q.count_if("risk_level = 'medium'")} AS medium,
  {Q.count_if("risk_level = 'low'")} AS low, {Q.r('avg(delay_risk_score)')} AS avg_risk FROM scored)""")
def zone_level_summary(spark, folder):
    return SC.level_summary(P.scored(spark, folder))


@query("L-01 L-02 A-39", Q.with_(*Q.TO_SCORED) + "SELECT zone_id, delay_risk_score, risk_level, taxi_count, explanation_tag FROM scored ORDER BY delay_risk_score DESC, zone_id LIMIT 5"
       .replace("FROM scored ORDER", "FROM scored WHERE timestamp = (SELECT max(timestamp) FROM scored) ORDER"))
def top_zones(spark, folder):
    return RP.driver_digest(_now_rows(spark, folder))


@query("P-07 P-08 J-10 L-03", Q.with_(*_TO_CARDS, _LATEST) + """SELECT n.zone_id, n.zone_name, n.region, n.risk_level, n.delay_risk_score, n.taxi_count AS current_supply,
  coalesce(c.recommendation, 'No action required') AS recommendation FROM now_rows n LEFT JOIN (SELECT zone_id, arg_max(recommendation, timestamp) AS recommendation FROM card GROUP BY 1) c
  ON c.zone_id = n.zone_id WHERE n.risk_level = 'medium' AND lower(n.zone_name) LIKE '%zone%'""")
def zone_list(spark, folder):
    zones = RP.zone_list(_now_rows(spark, folder), card_rows(spark, folder), "Medium", search="ZONE", card_order="timestamp")
    return zones.select("zone_id", "zone_name", "region", "risk_level", "delay_risk_score", "current_supply", "recommendation")


@query("J-10", Q.with_(*_TO_CARDS, _LATEST) + """SELECT n.zone_id, n.delay_risk_score, coalesce((SELECT arg_min(recommendation, timestamp) FROM card WHERE zone_id = 3), 'No action required') AS recommendation
  FROM now_rows n WHERE n.zone_id = 3""")
def zone_detail(spark, folder):
    return RP.zone_detail(_now_rows(spark, folder), card_rows(spark, folder), 3, "timestamp").select("zone_id", "delay_risk_score", "recommendation")


@query("S-17", Q.with_(*Q.TO_SCORED, _LATEST) + """SELECT zone_id, zone_name, region, risk_level, printf('%.4f', delay_risk_score) AS delay_risk_score, CAST(taxi_count AS VARCHAR) AS current_supply,
  printf('%.4f', supply_vs_yesterday) AS supply_vs_yesterday, printf('%.4f', depletion_rate_1h) AS depletion_rate_1h, explanation_tag, 'say "wait", then go' AS recommendation FROM now_rows""")
def export_view(spark, folder):
    rows = _now_rows(spark, folder).withColumns({"current_supply": F.col("taxi_count"), "recommendation": F.lit('say "wait", then go')})
    at = scratch_path(spark, "view")
    WR.write_csv(RP.export_view(rows), at, quote_all=True)
    back = spark.read.option("header", True).option("escape", '"').csv(at)
    return back.withColumn("zone_id", F.col("zone_id").cast("long"))


def history(spark, folder):
    return P.scored(spark, folder).select("timestamp", "zone_id", F.col("delay_risk_score").alias("score"), "taxi_count")


def _half(cond: str) -> str:
    return f"CAST(sum(CAST(delay_risk_score AS DECIMAL(18,6))) FILTER (WHERE {cond}) AS DOUBLE) / nullif(count(*) FILTER (WHERE {cond}), 0)"


_PERF = f"""perf AS (SELECT *, {Q.r('d')} AS trend_delta, CASE WHEN d < -0.05 THEN 'improving' WHEN d > 0.05 THEN 'deteriorating' ELSE 'stable' END AS trend FROM (
  SELECT zone_id, {Q.r(_half('true'))} AS mean_score, {Q.r('avg(CASE WHEN delay_risk_score >= 0.7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS pct_time_high,
   {Q.r('avg(CASE WHEN delay_risk_score >= 0.4 AND delay_risk_score < 0.7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS pct_time_medium,
   {Q.r('avg(CASE WHEN delay_risk_score < 0.4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS pct_time_low, CAST(count(*) AS BIGINT) AS observations,
   coalesce(({_half(f'timestamp >= {Q.NOW_SQL} - INTERVAL 84 HOUR')}) - ({_half(f'timestamp < {Q.NOW_SQL} - INTERVAL 84 HOUR')}), 0.0::DOUBLE) AS d
  FROM scored WHERE timestamp >= {Q.NOW_SQL} - INTERVAL 7 DAY GROUP BY 1))"""
_PERF_COLS = "zone_id, mean_score, pct_time_high, pct_time_medium, pct_time_low, trend_delta, trend, observations"


@query("A-12 W-16 P-13 J-16", Q.with_(*Q.TO_SCORED, _PERF) + f"SELECT {_PERF_COLS}, 'Zone' || CAST(zone_id AS VARCHAR) AS zone_name FROM perf")
def zone_performance(spark, folder):
    perf = RP.zone_performance(history(spark, folder), P.now(), 7, P.zone_dimension(spark))
    return perf.select(*_PERF_COLS.split(", "), "zone_name")


@query("L-07", Q.with_(*Q.TO_SCORED, _PERF) + """SELECT list_name, list_rank, zone_id, trend FROM (SELECT *, row_number() OVER (PARTITION BY list_name ORDER BY k, zone_id) AS list_rank FROM (
  SELECT 'chronic_high_risk' AS list_name, -pct_time_high AS k, * FROM perf UNION ALL SELECT 'most_improved', trend_delta, * FROM perf WHERE trend = 'improving'
  UNION ALL SELECT 'deteriorating', -trend_delta, * FROM perf WHERE trend = 'deteriorating')) WHERE list_rank <= 5""")
def performance_lists(spark, folder):
    return RP.performance_lists(RP.zone_performance(history(spark, folder), P.now(), 7)).select("list_name", "list_rank", "zone_id", "trend")


@query("P-11", Q.with_(Q.RUNS) + "SELECT timestamp, supply_now AS value FROM runs WHERE timestamp >= (SELECT max(timestamp) FROM runs) - INTERVAL 24 HOUR")
def trend_window(spark, folder):
    return RP.recent_points(RP.trend(P.runs(spark, folder), "supply_now", "flagged_zones"), 24)


@query("X-09", Q.with_(Q.RUNS) + "SELECT timestamp, flagged_zones AS value FROM runs")
def run_trend(spark, folder):
    """The new field is empty throughout, so the older one is used."""
    runs = P.runs(spark, folder).withColumn("high_risk_zones_now", F.lit(None).cast("long"))
    return RP.trend(runs, "high_risk_zones_now", "flagged_zones")


@query("W-13", Q.with_(Q.RUNS) + "SELECT run_id, timestamp, rows_scored, failed_rows FROM runs ORDER BY timestamp DESC LIMIT 20")
def newest_runs(spark, folder):
    return RP.newest(P.runs(spark, folder), 20).select("run_id", "timestamp", "rows_scored", "failed_rows")


@query("W-15", Q.with_(Q.RUNS) + "SELECT timestamp, psi AS value FROM runs ORDER BY timestamp DESC LIMIT 8")
def psi_spark_points(spark, folder):
    return RP.spark_points(P.runs(spark, folder), "timestamp", "psi", 8)


def _logged_alerts(spark, folder):
    """Errors as logged alerts, one id per user group."""
    e = P.events(spark, folder).filter(F.col("event_type") == "error")
    return e.select(F.concat(F.lit("A"), (F.col("user_id") % 40).cast("string")).alias("alert_id"), F.lit("high").alias("severity"),
                    F.col("event_id").cast("string").alias("message"), F.lit(None).cast("int").alias("zone_id"), F.col("ts").alias("created_at"))


_ALERTS = f"""logged AS (SELECT 'A' || CAST(user_id % 40 AS VARCHAR) AS alert_id, CAST(event_id AS VARCHAR) AS message, ts AS created_at FROM events WHERE event_type = 'error'),
derived AS (SELECT 'HIGH_FAILED_ROWS' AS alert_id, CAST(failed_rows AS VARCHAR) || ' rows failed validation in latest batch (' ||
  CAST(CAST(round_even(failed_rows / greatest(rows_scored, 1) * 100.0::DOUBLE, 0) AS INTEGER) AS VARCHAR) || '%)' AS message, timestamp AS created_at
  FROM (SELECT * FROM runs ORDER BY timestamp DESC LIMIT 1) WHERE failed_rows / greatest(rows_scored, 1) > 0.10::DOUBLE),
merged AS (SELECT * FROM logged WHERE created_at >= {Q.NOW_SQL} - INTERVAL 24 HOUR UNION ALL SELECT * FROM derived)"""


@query("U-02 W-14 P-12", Q.with_(Q.RUNS, _ALERTS) + "SELECT alert_id, arg_max(message, {'c': created_at, 'm': message}) AS message, max(created_at) AS created_at FROM merged GROUP BY 1")
def merged_alerts(spark, folder):
    derived = DR.failed_row_alerts(RP.newest(P.runs(spark, folder), 1))
    return RP.all_alerts(_logged_alerts(spark, folder), derived, P.now()).select("alert_id", "message", "created_at")


@query("X-16", Q.with_(*Q.TO_SCORED, _LATEST, _DRIFT) + """SELECT * FROM (SELECT 'HIGH_RISK_ZONES' AS alert_id, CAST(n AS VARCHAR) || ' zones currently at high depletion risk' AS message FROM (
  SELECT count(*) FILTER (WHERE risk_level = 'high') AS n FROM now_rows) WHERE n >= 1 UNION ALL SELECT 'DRIFT_DETECTED', 'Model prediction drift detected — review recommended' FROM drift WHERE round_even(psi, 4) > 0.0001)""")
def active_alerts(spark, folder):
    """Thresholds are low because there are five zones and the two halves of the month differ little."""
    drifted = (_event_drift(spark, folder).select("psi").scalar() > 0.0001)
    return RP.snapshot_alerts(_now_rows(spark, folder), drifted, P.now(), many=1).select("alert_id", "message")


@query("G-07", f"""SELECT service, CASE WHEN age > 3600 THEN 'degraded' ELSE 'ok' END AS status FROM (SELECT event_type AS service,
  date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-01-31 00:30:00') AS age FROM events GROUP BY 1)""")
def service_freshness(spark, folder):
    seen = P.events(spark, folder).groupBy(F.col("event_type").alias("service")).agg(F.date_trunc("second", F.max("ts")).alias("last_updated"))
    return RP.freshness(seen, F.lit("2024-01-31 00:30:00").cast("timestamp")).select("service", "status")


@query("G-08 G-10", Q.with_(Q.RUNS) + "SELECT run_id, timestamp, rows_scored, psi FROM runs ORDER BY timestamp DESC LIMIT 1")
def latest_run(spark, folder):
    return RP.latest_or_default(P.runs(spark, folder).select("run_id", "timestamp", "rows_scored", "psi"), {"rows_scored": 0})


# --- history ----------------------------------------------------------------

@query("S-18 T-09", Q.with_(*Q.TO_SCORED) + f"""SELECT timestamp AS run_ts, zone_id, delay_risk_score AS score, taxi_count FROM scored
  WHERE timestamp > (SELECT max(timestamp) FROM scored) - INTERVAL {S.HISTORY_DAYS} DAY""")
def bounded_history(spark, folder):
    kept = SC.recent_runs(SC.history_rows(P.scored(spark, folder)), 24 * S.HISTORY_DAYS, P.newest_hour(spark, folder))
    return kept.select("run_ts", "zone_id", "score", "taxi_count")


@query("X-08", Q.with_(*Q.TO_SCORED) + """SELECT timestamp, delay_risk_score AS value FROM scored WHERE zone_id = 2
  AND timestamp > (SELECT max(timestamp) FROM scored) - INTERVAL 48 HOUR""")
def zone_score_history(spark, folder):
    return SC.zone_history(SC.history_maps(SC.history_rows(P.scored(spark, folder))), 2, hours=48, newest=P.newest_hour(spark, folder))


@query("X-08 S-06", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS zone_key FROM events""")
def json_map_history(spark, folder):
    e = table(use_utc(spark), folder, "events").select("event_id", "props")
    maps = e.withColumn("m", F.from_json("props", "map<string,string>"))
    return maps.select("event_id", safe_int(F.col("m")["k"], -1).alias("zone_key"))


@query("S-08 X-12", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_field_scan(spark, folder):
    e = table(use_utc(spark), folder, "events").select("event_id", "props")
    return from_text(e, "props", "k int").select("event_id", "k")


@query("X-12", """SELECT event_id, '{"event_id":' || CAST(event_id AS VARCHAR) || ',"half":' || CASE WHEN value < 1 THEN 'null' ELSE CAST(user_id AS VARCHAR) || '.0' END || '}' AS json FROM events""")
def json_rows(spark, folder):
    e = table(use_utc(spark), folder, "events")
    half = F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("user_id").cast("double"))
    return json_text(e.select("event_id", half.alias("half")), ["event_id", "half"]).select("event_id", "json")


# --- versions ---------------------------------------------------------------

_VERSION_COLS = 'version_id, status, trained_at, "precision", f1'


@query("L-10 G-01", Q.with_(Q.VERSIONS) + f"SELECT {_VERSION_COLS} FROM judged WHERE NOT removable")
def version_lineage(spark, folder):
    return V.lineage(V.current_versions(P.version_events(spark, folder))).select("version_id", "status", "trained_at", "precision", "f1")


@query("G-01", Q.with_(Q.VERSIONS) + """, new AS (SELECT 'v999912' AS version_id), steps(step) AS (VALUES (1), (2), (3))
SELECT step, version_id, CASE WHEN status = 'active' AND step = 2 THEN 'previous' ELSE status END AS status FROM ver, steps
UNION ALL SELECT step, version_id, CASE step WHEN 1 THEN 'candidate' WHEN 2 THEN 'active' ELSE 'rolled_back' END FROM new, steps""")
def version_transitions(spark, folder):
    """A new version is registered, promoted and rolled back: every version's status after each step."""
    events, out = P.version_events(spark, folder), None
    at = lambda day: F.lit(f"2031-01-0{day} 00:00:00").cast("timestamp")
    for step in (1, 2, 3):
        now = V.current_versions(events)
        more = (V.register_event(spark, "v999912", "2031-01-01 00:00:00", {"f1": 0.9}) if step == 1 else
                V.promote_events(now, "v999912", at(2)) if step == 2 else V.rollback_events(now, at(3)))
        events = written(events.unionByName(more), "versions")
        here = V.current_versions(events).select(F.lit(step).alias("step"), "version_id", "status")
        out = here if out is None else out.unionByName(here)
    return out


@query("G-03 M-31", Q.with_(Q.VERSIONS) + "SELECT version_id, status FROM judged WHERE removable")
def version_prunable(spark, folder):
    return V.prunable(V.current_versions(P.version_events(spark, folder)))


@query("G-04", Q.with_(Q.VERSIONS) + "SELECT version_id, status FROM ranked WHERE status = 'previous' ORDER BY recency DESC, version_id DESC LIMIT 1")
def rollback_target(spark, folder):
    return V.rollback_target(V.current_versions(P.version_events(spark, folder))).select("version_id", "status")


_TARGET = "(SELECT version_id FROM ranked WHERE status = 'previous' ORDER BY recency DESC, version_id DESC LIMIT 1)"


@query("G-05", Q.with_(Q.VERSIONS, Q.RUNS) + f"""SELECT 'rollback' AS event, model_version AS from_version, {_TARGET} AS to_version, run_id FROM runs
  WHERE (rows_scored > 0 AND failed_rows / (rows_scored + failed_rows) > 0.20::DOUBLE) OR psi > 0.25 OR drift_flag""")
def rollback_audit(spark, folder):
    judged = DR.rollback_rule(P.runs(spark, folder))
    return V.rollback_audit(judged, V.current_versions(P.version_events(spark, folder)), P.now()).select("event", "from_version", "to_version", "run_id")


@query("G-02 G-09", Q.with_(Q.VERSIONS) + """SELECT a.version_id AS active_version, a.trained_at AS last_retrained_at, a.f1, u.version_id AS candidate_version FROM
  (SELECT * FROM ver WHERE status = 'active') a, undertest u""")
def model_status(spark, folder):
    return V.model_status(V.current_versions(P.version_events(spark, folder))).select("active_version", "last_retrained_at", "f1", "candidate_version")


def _cut(versions):
    return versions.filter(F.col("version_id") == V.newest_candidate(versions)), V.active_version(versions)


@query("J-14", Q.with_(Q.VERSIONS) + " UNION ALL ".join(f"""SELECT '{m}' AS metric, c."{m}" AS candidate, a."{m}" AS active, {Q.r(f'c."{m}" - a."{m}"')} AS delta,
  CASE WHEN a."{m}" > 0 THEN (c."{m}" - a."{m}") / a."{m}" < -0.05::DOUBLE ELSE false END AS regressed FROM ver c JOIN undertest USING (version_id), (SELECT * FROM ver WHERE status = 'active') a"""
                                                        for m in V.METRICS))
def version_compare(spark, folder):
    return V.compare_versions(*_cut(V.current_versions(P.version_events(spark, folder))))


def _feature_names(spark, folder, sizes):
    """Names from all parts; fewer size classes give fewer names."""
    return table(use_utc(spark), folder, "part").select(F.concat_ws("|", "p_brand", (F.col("p_size") % sizes).cast("string")).alias("feature"))


_GONE = """gone AS (SELECT DISTINCT p_brand || '|' || CAST(p_size % 25 AS VARCHAR) AS feature FROM part
  WHERE p_brand || '|' || CAST(p_size % 25 AS VARCHAR) NOT IN (SELECT p_brand || '|' || CAST(p_size % 23 AS VARCHAR) FROM part))"""


@query("J-15 U-03", Q.with_(_GONE) + "SELECT feature FROM gone")
def removed_features(spark, folder):
    return V.removed_features(_feature_names(spark, folder, 25), _feature_names(spark, folder, 23))


_GATE_REASON = f"""concat_ws('; ', CASE WHEN NOT (f1 >= 0.5 AND roc_auc >= 0.65) THEN 'performance below threshold (F1=' || printf('%.3f', {Q.r('f1', 3)}) || ' min=0.5, AUC=' || printf('%.3f', {Q.r('roc_auc', 3)}) || ' min=0.65)' END,
  CASE WHEN NOT regression_ok THEN 'metric regression > 5% vs active model' END,
  CASE WHEN NOT schema_ok THEN 'schema regression: features removed=' || (SELECT string_agg(feature, ', ' ORDER BY feature) FROM gone) END,
  CASE WHEN NOT integration_ok THEN 'integration test failed: predictions outside [0, 1] or missing' END,
  CASE WHEN NOT stability_ok THEN 'stability check failed: variance ratio > 3.0' END)"""
_STABLE = """stable AS (SELECT count(p) = count(*) AND min(p) >= 0 AND max(p) <= 1 AS integration_ok,
  coalesce(stddev_pop(other) = 0 OR stddev_pop(p) / nullif(stddev_pop(other), 0) <= 3.0::DOUBLE, true) AS stability_ok
  FROM (SELECT p, least(n_chars / 15000.0::DOUBLE, 1.0::DOUBLE) AS other FROM lab))"""


@query("M-32 Q-11", Q.with_(Q.VERSIONS, _GONE, Q.LABELLED, _STABLE) + f"""SELECT version_id, f1 >= 0.5 AND roc_auc >= 0.65 AS performance_ok, regression_ok, schema_ok, integration_ok, stability_ok,
  f1 >= 0.5 AND roc_auc >= 0.65 AND regression_ok AND schema_ok AND integration_ok AND stability_ok AS passed, CASE WHEN {_GATE_REASON} = '' THEN 'all checks passed' ELSE {_GATE_REASON} END AS reason FROM (
  SELECT c.*, NOT (""" + " OR ".join(f'(a."{m}" > 0 AND (c."{m}" - a."{m}") / a."{m}" < -0.05::DOUBLE)' for m in V.METRICS) + """) AS regression_ok,
   NOT EXISTS (SELECT 1 FROM gone) AS schema_ok, (SELECT integration_ok FROM stable) AS integration_ok, (SELECT stability_ok FROM stable) AS stability_ok
   FROM ver c JOIN undertest USING (version_id), (SELECT * FROM ver WHERE status = 'active') a)""")
def promotion_gate(spark, folder):
    candidate, active = _cut(V.current_versions(P.version_events(spark, folder)))
    lab = P.labelled(spark, folder)
    # Two fixed scores stand in for the two models on the holdout table.
    other = F.least(F.col("n_chars") / F.lit(15000.0), F.lit(1.0))
    stability = lab.agg(F.stddev_pop("p").alias("candidate_std"), F.stddev_pop(other).alias("active_std"), F.min("p").alias("lowest"),
                        F.max("p").alias("highest"), F.count("p").alias("n_scored"), F.count(F.lit(1)).alias("n_rows"))
    removed = V.removed_features(_feature_names(spark, folder, 25), _feature_names(spark, folder, 23))
    return V.gate(candidate, active, removed, stability)


@query("G-06 X-13", Q.with_(Q.VERSIONS, _DRIFT) + f"""SELECT version_id AS active_version, {Q.r('psi')} AS psi,
  CASE WHEN {Q.r('psi')} >= 0.25 THEN 'significant' WHEN {Q.r('psi')} >= 0.10 THEN 'moderate' ELSE 'stable' END AS psi_level,
  'PSI=' || printf('%.3f', {Q.r('psi')}) || CASE WHEN {Q.r('psi')} >= 0.25 THEN ' indicates significant data drift — the live distribution differs materially from training data. Model predictions are less reliable; expect more false positives and missed depletion-risk alerts.'
    WHEN {Q.r('psi')} >= 0.10 THEN ' indicates moderate drift — early warning signal. Model performance may be degrading; monitor closely and consider retraining soon.'
    ELSE ' — distribution is stable. Model is operating within expected parameters.' END || ' Current precision: ' || printf('%.1f', {Q.r('"precision" * 100.0::DOUBLE', 1)}) || '%.' AS psi_business_impact,
  CAST((SELECT count(*) FROM judged WHERE NOT removable) AS INTEGER) AS lineage_size FROM ver, drift WHERE status = 'active'""")
def model_impact(spark, folder):
    m = V.model_impact(_event_drift(spark, folder), V.current_versions(P.version_events(spark, folder)), P.now())
    return m.select("active_version", "psi", "psi_level", "psi_business_impact", F.size("version_lineage").alias("lineage_size"))


@query("X-13", """SELECT l_orderkey, l_linenumber, l_partkey, 'At precision=' || CAST(100 - CAST(round_even(l_discount * 100, 0) AS INTEGER) AS VARCHAR) || '.0%, roughly ' || CAST(CAST(round_even(l_discount * 100, 0) AS INTEGER) AS VARCHAR) ||
  '% of high-risk alerts are false positives. For every 10 interventions dispatched to high-risk zones, ~' || CAST(CAST(round_even((1.0::DOUBLE - (1.0::DOUBLE - l_discount)) * 10.0::DOUBLE, 0) AS BIGINT) AS VARCHAR) ||
  ' may be unnecessary. Retraining on more recent data can reduce this.' AS note FROM lineitem""")
def precision_notes(spark, folder):
    li = table(use_utc(spark), folder, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", T.false_positive_note(F.lit(1.0) - F.col("l_discount")).alias("note"))


@query("P-14", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS as_number, CASE WHEN value > 1 THEN value END AS cleaned FROM events""")
def safe_values(spark, folder):
    from zonetide.functions.numeric import finite, safe_double

    e = table(use_utc(spark), folder, "events")
    raw = F.when(F.col("value") > 1, F.col("value")).otherwise(F.lit(float("inf")))
    return e.select("event_id", safe_double(F.get_json_object("props", "$.k")).alias("as_number"), finite(raw).alias("cleaned"))


@query("D-10", """SELECT o_orderkey, CAST(year(CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '0001-01-01 00:00:00' ELSE o_orderdate END) AS INTEGER) AS year_read FROM orders""")
def tolerant_times(spark, folder):
    o = table(use_utc(spark), folder, "orders")
    text = F.when(F.col("o_orderstatus") == "P", "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", F.year(clock.parse_iso_or_epoch_start(text)).alias("year_read"))


