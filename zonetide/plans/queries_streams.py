"""Streams over the events, run until the source is exhausted.

A stream emits a window only when later rows have passed it. The tables are at their end, so the streams are closed: a last row that
has nothing but a late time lets go of what they still hold.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from zonetide.plans import proxies as P
from zonetide.plans import sql as Q
from zonetide.plans.catalogue import query
from zonetide.plans.queries_decisions import _CANDS, _GAIN, _RUN_SQL, _SPARE, SMALL_BUDGET
from zonetide.plans.queries_features import SNAP, snapshots
from zonetide.session import scratch_path, use_utc, written
from zonetide.settings import ACTIONS
from zonetide.sources.readers import table
from zonetide.streaming import ingest, monitor, outcomes, state, windows
from zonetide.streaming.store import BatchTable

def event_stream(spark, folder):
    """The events table as a file stream with zones and instants."""
    schema = table(use_utc(spark), folder, "events").schema
    # A pattern, because a stream reads folders and the table may be a single file.
    raw = ingest.file_stream(spark, f"{folder}/events.parque[t]", schema)
    return raw.withColumns({"timestamp": F.col("ts").cast("timestamp"), "zone_id": F.col("user_id") % P.ZONES + 1})


def closed(spark, events, step, label):
    """What ``step`` makes of the whole stream of events, its last windows included."""
    folder = scratch_path(spark, "closing")
    return ingest.caught_up(step(ingest.closable(events, "timestamp", folder)), label, closing=("timestamp", folder))


@query("T-01", "SELECT event_id, user_id % 5 + 1 AS zone_id, ts AS timestamp FROM events")
def stream_ingest(spark, folder):
    return ingest.caught_up(event_stream(spark, folder).select("event_id", "zone_id", "timestamp"), "ingest")


@query("T-01 S-03", Q.with_(SNAP, Q.DIM) + "SELECT zone_id, timestamp, CAST(taxi_count AS INTEGER) AS taxi_count FROM snap JOIN dim USING (zone_id)")
def stream_snapshots(spark, folder):
    """Five-minute snapshots as CSV files that come in over three runs of the stream."""
    at = scratch_path(spark, "snapshots")
    rows = written(snapshots(spark, folder).join(P.zone_dimension(spark), "zone_id"), "snapshots")
    names = rows.select("zone_id", "zone_name", "region", "zone_type", "taxi_count", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    for part in range(3):
        names.filter(F.dayofmonth(F.col("timestamp").cast("timestamp")) % 3 == part).write.mode("append").option("header", True).csv(f"{at}/files")
        stream = ingest.snapshot_stream(spark, f"{at}/files")
        ingest.start(stream, f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows").select(F.col("zone_id").cast("long").alias("zone_id"), "timestamp", "taxi_count")


@query("T-02", f"""SELECT user_id % 5 + 1 AS zone_id, date_trunc('hour', ts) AS timestamp, CAST(count(*) AS BIGINT) AS taxi_count FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, folder):
    return closed(spark, event_stream(spark, folder), windows.tumbling_counts, "tumbling")


@query("T-02", f"""SELECT user_id % 5 + 1 AS zone_id, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  CAST(round_even(avg(user_id), 0) AS INTEGER) AS user_id FROM events GROUP BY 1, 2, 3""")
def stream_hourly_mean(spark, folder):
    return closed(spark, event_stream(spark, folder), lambda e: windows.tumbling_mean(e, "user_id"), "hourly-mean")


@query("T-03", f"""SELECT zone_id, w AS window_start, w + INTERVAL 1 HOUR AS window_end, CAST(round_even(avg(user_id), 0) AS INTEGER) AS user_id FROM (
  SELECT user_id % 5 + 1 AS zone_id, user_id, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 55 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts), INTERVAL 5 MINUTE)) AS w FROM events)
  GROUP BY 1, 2""")
def stream_sliding(spark, folder):
    return closed(spark, event_stream(spark, folder), lambda e: windows.sliding_mean(e, "user_id"), "sliding")


@query("T-06 J-12", """SELECT recommendation_id, zone_id, scored_at, score_after, CASE WHEN ratio <= 0.70::DOUBLE THEN 'recovered' WHEN ratio <= 0.90::DOUBLE THEN 'improved'
   WHEN ratio >= 1.10::DOUBLE THEN 'worsened' ELSE 'unchanged' END AS outcome FROM (SELECT *, CASE WHEN b > 0 THEN score / b ELSE 1.0::DOUBLE END AS ratio, """ + Q.r("score") + """ AS score_after FROM (
  SELECT a.event_id AS recommendation_id, a.user_id AS zone_id, a.value / 100.0::DOUBLE AS b, min(c.ts) AS scored_at, arg_min(c.value / 100.0::DOUBLE, {'t': c.ts, 'v': c.value}) AS score FROM events a JOIN events c
   ON c.user_id = a.user_id AND c.event_type = 'view' AND c.ts >= a.ts + INTERVAL 30 MINUTE AND c.ts <= a.ts + INTERVAL 24 HOUR WHERE a.event_type = 'purchase' GROUP BY 1, 2, 3))""")
def stream_outcomes(spark, folder):
    """Purchases as recommendations, views as later scores, users as zones."""
    kind, zone = F.col("event_type"), F.col("user_id").alias("zone_id")
    issued = event_stream(spark, folder).filter(kind == "purchase").select(
        F.col("event_id").alias("recommendation_id"), zone, F.col("timestamp").alias("logged_at"), (F.col("value") / F.lit(100.0)).alias("score_at_time"))
    scores = event_stream(spark, folder).filter(kind == "view").select(zone, F.col("timestamp").alias("scored_at"), (F.col("value") / F.lit(100.0)).alias("score"))
    return outcomes.first_outcomes(ingest.caught_up(outcomes.matched(issued, scores), "outcomes"))


@query("T-04 W-12", """SELECT zone_id, timestamp, CAST(sum(hit) OVER (PARTITION BY zone_id, island ORDER BY timestamp) AS INTEGER) AS persistence_count FROM (
  SELECT *, sum(1 - hit) OVER (PARTITION BY zone_id ORDER BY timestamp) AS island FROM (SELECT user_id AS zone_id, ts AS timestamp, CAST(value / 100.0::DOUBLE > 0.25::DOUBLE AS INTEGER) AS hit FROM events))""")
def stream_persistence(spark, folder):
    """Run lengths per user, carried from batch to batch: the month's weeks arrive one after the other, each as a batch."""
    rows = P.events(spark, folder).select(F.col("user_id").alias("zone_id"), F.col("ts").alias("timestamp"), (F.col("value") / F.lit(100.0)).alias("predicted_shortage"))
    at = scratch_path(spark, "persistence")
    week = F.floor((F.dayofmonth("timestamp") - 1) / 7)
    for number in range(5):
        rows.filter(week == number).write.mode("append").parquet(f"{at}/files")
        ingest.run_batches(ingest.file_stream(spark, f"{at}/files", rows.schema), state.persistence_batches(spark, at), f"{at}/checkpoint")
    return BatchTable(spark, f"{at}/rows").read().select("zone_id", "timestamp", "persistence_count")


@query("T-07 A-23", f"""WITH t AS (SELECT value / 500.0::DOUBLE AS v, ts >= TIMESTAMP '2024-01-16' AS cur FROM events), s AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 10.0::DOUBLE AS step FROM t),
g AS (SELECT v, cur, lo, step, least(floor((v - lo) / step), 9) AS g FROM t, s), d AS (SELECT *, g - CASE WHEN v < lo + g * step THEN 1 ELSE 0 END AS d FROM g),
c AS (SELECT d + CASE WHEN d < 9 AND v >= lo + (d + 1) * step THEN 1 ELSE 0 END AS bin, count(*) FILTER (WHERE NOT cur) AS c0, count(*) FILTER (WHERE cur) AS c1 FROM d GROUP BY 1)
SELECT {Q.r('sum((a - e) * ln(a / e))')} AS psi, CAST((SELECT count(*) FROM t) AS BIGINT) AS rows_compared FROM (SELECT greatest(c0 / sum(c0) OVER (), 1e-6::DOUBLE) AS e, greatest(c1 / sum(c1) OVER (), 1e-6::DOUBLE) AS a FROM c)""")
def stream_drift(spark, folder):
    """Two files, two batches: the second is compared with the first (the measure is symmetric)."""
    at = scratch_path(spark, "drift")
    half = (F.col("ts") >= F.lit("2024-01-16").cast("timestamp")).cast("int")
    e = P.events(spark, folder).select((F.col("value") / F.lit(500.0)).alias("delay_risk_score"), half.alias("half"))
    e.repartition("half").write.partitionBy("half").parquet(f"{at}/files")
    rows = ingest.file_stream(spark, f"{at}/files", e.schema, max_files=1)
    ingest.run_batches(rows, monitor.drift_batches(spark, at), f"{at}/checkpoint")
    reports = monitor.drift_reports(spark, at)
    return reports.select("psi", (F.col("reference_n") + F.col("current_n")).alias("rows_compared"))


@query("T-09 S-18", """WITH hourly AS (SELECT date_trunc('hour', ts) AS h, user_id % 5 + 1 AS zone_id, CAST(count(*) AS BIGINT) AS taxi_count FROM events GROUP BY 1, 2)
  SELECT h AS run_ts, zone_id, 0.5::DOUBLE AS score, taxi_count FROM hourly WHERE h > (SELECT max(h) FROM hourly) - INTERVAL 14 DAY""")
def stream_history(spark, folder):
    """Hourly counts appended to a history, batch by batch; the last 14 days are read back."""
    at = scratch_path(spark, "history")
    hourly = windows.tumbling_counts(ingest.closable(event_stream(spark, folder), "timestamp", f"{at}/closing")).withColumn("delay_risk_score", F.lit(0.5))
    step = monitor.history_batches(spark, f"{at}/rows")
    ingest.run_batches(hourly, step, f"{at}/checkpoint")
    ingest.close(spark, "timestamp", f"{at}/closing")
    ingest.run_batches(hourly, step, f"{at}/checkpoint")
    return monitor.recent_history(monitor.history(spark, f"{at}/rows"), 14).select("run_ts", "zone_id", "score", "taxi_count")


#: Cooldowns of several hours, so that they outlast the hourly rows, and cheap incentives, so that the budget runs out.
STREAM = replace(SMALL_BUDGET, cost_weight=0.01, actions=tuple(replace(a, cooldown_minutes=4 * a.cooldown_minutes) for a in ACTIONS))


def _replay(cfg) -> str:
    """Row by row in order of time, the way a single process would do it. ``last`` has the time of each action (of five) in each zone."""
    acts = "acts(rnk, action, cost, uplift, boost, spends, needs, free, cd) AS (VALUES " + ", ".join(
        f"({i}, '{a.name}', {a.cost}::DECIMAL(12,4), {a.uplift}::DOUBLE, {a.boost}::DOUBLE, {str(a.spends_budget).lower()}, {str(a.needs_surplus).lower()}, "
        f"{str(a.always_allowed).lower()}, {a.cooldown_minutes * 60})" for i, a in enumerate(cfg.actions)) + ")"
    spare = _SPARE.replace("taxi_count", "s.taxi_count").replace("baseline_supply", "s.baseline_supply")
    rows = f"""spare AS (SELECT c.zone_id, c.timestamp, {Q.r(f'sum({spare})')} AS ns FROM (SELECT zone_id, zone_name, timestamp, neighbor FROM counted JOIN ring ON zone = zone_name) c
  ASOF JOIN scored s ON s.zone_name = c.neighbor AND s.timestamp <= c.timestamp GROUP BY 1, 2),
drows AS (SELECT c.*, coalesce(sp.ns, 0.0) AS neighbor_surplus, {Q.SEVERITY} AS severity_bucket FROM counted c LEFT JOIN spare sp USING (zone_id, timestamp)),
options AS (SELECT *, {Q.r(f"shortage_reduction * 1.0::DOUBLE - cost::DOUBLE * {cfg.cost_weight}::DOUBLE - (CASE WHEN action = 'ops_alert' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END)")} AS net_value
  FROM (SELECT d.zone_id, d.timestamp, a.*, d.persistence_count, d.neighbor_surplus, {_GAIN} AS shortage_reduction FROM drows d JOIN cands k ON k.sev = d.severity_bucket JOIN acts a ON a.action = k.cact)
  WHERE (free OR persistence_count >= 2) AND (NOT needs OR neighbor_surplus > 0)),
queue AS MATERIALIZED (SELECT d.zone_id, d.timestamp, d.severity_bucket, CAST(epoch(d.timestamp) AS BIGINT) AS t, CAST(d.timestamp AS DATE) AS day, row_number() OVER (ORDER BY d.timestamp, d.zone_id) AS rn, opts
  FROM drows d LEFT JOIN (SELECT zone_id, timestamp, list({{'a': rnk, 'cost': cost, 'spends': spends, 'cd': cd}} ORDER BY net_value DESC, rnk) AS opts FROM options GROUP BY 1, 2) o USING (zone_id, timestamp)),
st AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS DATE) AS day, CAST(10 AS DECIMAL(12,4)) AS budget, CAST(NULL AS BIGINT) AS zone_id, CAST(NULL AS TIMESTAMP) AS timestamp,
   CAST(0 AS DECIMAL(12,4)) AS price, CAST(NULL AS INTEGER) AS took, list_transform(range(25), lambda i: CAST(NULL AS BIGINT)) AS last
  UNION ALL
  SELECT rn, day, budget, zone_id, timestamp, CASE WHEN took IN (SELECT rnk FROM acts WHERE spends) THEN (SELECT cost FROM acts WHERE rnk = took) ELSE 0 END AS price, took,
    list_transform(range(25), lambda i: CASE WHEN i = (zone_id - 1) * 5 + took THEN t ELSE last[i + 1] END) AS last FROM (
   SELECT *, CAST(coalesce(fit[1].a, CASE WHEN severity_bucket = 'severe' THEN 4 ELSE 0 END) AS INTEGER) AS took FROM (
    SELECT *, list_filter(opts, lambda o: (o.cd = 0 OR last[(zone_id - 1) * 5 + o.a + 1] IS NULL OR t - last[(zone_id - 1) * 5 + o.a + 1] >= o.cd) AND (NOT o.spends OR budget >= o.cost)) AS fit FROM (
     SELECT z.rn, z.day, z.zone_id, z.timestamp, z.severity_bucket, z.t, z.opts, s.last,
       CAST(CASE WHEN z.day IS DISTINCT FROM s.day THEN 10 ELSE greatest(s.budget - s.price, 0) END AS DECIMAL(12,4)) AS budget FROM st s JOIN queue z ON z.rn = s.rn + 1))))"""
    return "WITH RECURSIVE " + ",\n".join((*Q.TO_SCORED, Q.RING, _RUN_SQL, acts, _CANDS, rows)) + """
SELECT zone_id, timestamp, CAST(budget AS DOUBLE) AS remaining_budget, action AS recommended_action FROM st JOIN acts ON rnk = took"""


@query("T-04 T-05 N-05 N-06 W-18", _replay(STREAM))
def stream_decisions(spark, folder):
    """Scored zone-hours in five batches and a closing one, cut in the middle of days and of hours: run lengths, surplus, cooldowns and budgets go on across the cuts."""
    at = scratch_path(spark, "decide")
    scored = written(P.scored(spark, folder), "scored")
    first, last = (F.unix_timestamp(scored.agg(f("timestamp")).scalar()) for f in (F.min, F.max))
    # Zones of one hour may come in different batches, but no hour after a later one.
    place = (F.unix_timestamp("timestamp") - first + F.col("zone_id") * 600) / (last - first + 3001)
    step = state.decide_batches(spark, f"{at}/state", P.ring(spark), ["day"], STREAM)
    for number in range(5):
        scored.filter(F.floor(place * 5) == number).write.mode("append").parquet(f"{at}/files")
        rows = ingest.closable(ingest.file_stream(spark, f"{at}/files", scored.schema), "timestamp", f"{at}/closing")
        ingest.run_batches(rows, step, f"{at}/checkpoint")
    ingest.close(spark, "timestamp", f"{at}/closing")
    ingest.run_batches(rows, step, f"{at}/checkpoint")
    return state.decisions(spark, f"{at}/state").select("zone_id", "timestamp", "remaining_budget", "recommended_action")


@query("T-10", """WITH e AS (SELECT event_id, ts, least(4, (dayofmonth(ts) - 1 + CASE WHEN event_id % 7 = 0 THEN 9 ELSE 0 END) // 7) AS batch FROM events),
b AS (SELECT batch, max(ts) AS latest FROM e GROUP BY 1), w AS (SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 15 MINUTE AS watermark FROM b)
SELECT event_id, CAST(e.batch AS BIGINT) AS batch, coalesce(ts < watermark, false) AS late FROM e JOIN w ON w.batch = e.batch""")
def stream_late_rows(spark, folder):
    """Weeks as batches; every seventh event is delivered nine days late. Late rows are kept, with the batch they came in."""
    at = scratch_path(spark, "late")
    e = written(P.events(spark, folder).select("event_id", F.col("ts").alias("timestamp")), "events")
    week = F.least(F.lit(4), F.floor((F.dayofmonth("timestamp") - 1 + F.when(F.col("event_id") % 7 == 0, 9).otherwise(0)) / 7))
    step = ingest.late_batches(spark, f"{at}/state")
    for number in range(5):
        e.filter(week == number).write.mode("append").parquet(f"{at}/files")
        ingest.run_batches(ingest.file_stream(spark, f"{at}/files", e.schema), step, f"{at}/checkpoint")
    return ingest.kept_rows(spark, f"{at}/state").select("event_id", "batch", "late")


@query("T-10", """WITH e AS (SELECT ts, least(4, (dayofmonth(ts) - 1 + CASE WHEN event_id % 7 = 0 THEN 9 ELSE 0 END) // 7) AS batch FROM events),
b AS (SELECT batch, max(ts) AS latest FROM e GROUP BY 1), w AS (SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 15 MINUTE AS watermark FROM b)
SELECT CAST(e.batch AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE ts < watermark) AS BIGINT) AS late FROM e JOIN w ON w.batch = e.batch GROUP BY 1""")
def stream_late_counts(spark, folder):
    """How many rows of each batch were late."""
    at = scratch_path(spark, "late")
    e = written(P.events(spark, folder).select("event_id", F.col("ts").alias("timestamp")), "events")
    week = F.least(F.lit(4), F.floor((F.dayofmonth("timestamp") - 1 + F.when(F.col("event_id") % 7 == 0, 9).otherwise(0)) / 7))
    step = ingest.late_batches(spark, f"{at}/state")
    for number in range(5):
        e.filter(week == number).write.mode("append").parquet(f"{at}/files")
        ingest.run_batches(ingest.file_stream(spark, f"{at}/files", e.schema), step, f"{at}/checkpoint")
    return ingest.late_counts(spark, f"{at}/state").select("batch", "rows", "late")


@query("T-08", """WITH RECURSIVE a AS (SELECT user_id % 40 AS alert_number, ts, least(4, (dayofmonth(ts) - 1) // 7) AS week FROM events WHERE event_type = 'error'),
w AS (SELECT week, max(ts) AS latest FROM a GROUP BY 1), f AS (SELECT alert_number, week, min(ts) AS first FROM a GROUP BY 1, 2),
st AS (SELECT alert_number, week, first, true AS out FROM f WHERE (alert_number, week) IN (SELECT (alert_number, min(week)) FROM f GROUP BY alert_number)
  UNION ALL
  SELECT f.alert_number, f.week, f.first, NOT (st.out AND st.first > w.latest - INTERVAL 48 HOUR) FROM st JOIN w ON w.week = st.week JOIN f ON f.alert_number = st.alert_number AND f.week = st.week + 1)
SELECT alert_number, CAST(week AS BIGINT) AS week, first AS created_at FROM st WHERE out""")
def stream_alert_ids(spark, folder):
    """Weeks as batches: the first report of each alert passes, and again the first of a later week, once the alert's day is over.

    The end of an alert's day is noticed when the watermark, a day behind the newest row, has passed it.
    """
    at = scratch_path(spark, "alerts")
    e = written(P.events(spark, folder).filter(F.col("event_type") == "error").select(
        F.concat(F.lit("A"), (F.col("user_id") % 40).cast("string")).alias("alert_id"), F.col("ts").alias("created_at")), "alerts")
    week = F.least(F.lit(4), F.floor((F.dayofmonth("created_at") - 1) / 7))
    for number in range(5):
        # Reports in order of their time, so the one that passes is the first.
        e.filter(week == number).coalesce(1).sortWithinPartitions("created_at").write.mode("append").parquet(f"{at}/files")
        alerts = monitor.first_alerts(ingest.file_stream(spark, f"{at}/files", e.schema))
        ingest.start(alerts, f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    out = spark.read.schema(alerts.schema).parquet(f"{at}/rows")
    return out.select(F.substring("alert_id", 2, 9).cast("long").alias("alert_number"), week.cast("long").alias("week"), "created_at")
