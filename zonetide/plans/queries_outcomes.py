"""Outcomes, effectiveness, feedback, drift and classifier quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.functions import scoring as X
from zonetide.functions import text as T
from zonetide.functions.numeric import round_even
from zonetide.operators import drift as DR
from zonetide.operators import metrics as M
from zonetide.operators import outcomes as O
from zonetide.operators import scoring as SC
from zonetide.plans import proxies as P
from zonetide.plans import sql as Q
from zonetide.plans.catalogue import query
from zonetide.session import scratch_path, use_utc
from zonetide.sources import readers as R
from zonetide.sources import writers as WR
from zonetide.sources.readers import table

_DEC = "DECIMAL(18,6)"


def _mean(x: str, where: str) -> str:
    return f"coalesce(CAST(sum(CAST({x} AS {_DEC})) FILTER (WHERE {where}) AS DOUBLE) / nullif(count({x}) FILTER (WHERE {where}), 0), 0.0::DOUBLE)"


def effect_sql(source: str, keys: str) -> str:
    """Effectiveness statistics per key list, written as plain SQL."""
    def picked(tag, where):
        return (f"{Q.count_if(where + " AND outcome = 'recovered'")} AS {tag}_rec, {Q.count_if(where + " AND outcome IN ('recovered', 'improved')")} AS {tag}_imp, "
                f"{_mean('CAST(score_after AS DECIMAL(18,6)) - CAST(score_at_time AS DECIMAL(18,6))', where)} AS {tag}_delta, {_mean('supply_delta_30m', where)} AS {tag}_supply, "
                f"{_mean('estimated_cost_sgd', where)} AS {tag}_cost")
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}total, resolved, {Q.r("CASE WHEN known > 0 THEN followed / known ELSE 0.0::DOUBLE END")} AS follow_rate, followed_resolved, unfollowed_resolved,
  {Q.r('rr')} AS recovery_rate, {Q.r('ir')} AS improvement_rate, {Q.r('d')} AS estimated_score_delta, {Q.r('s')} AS expected_supply_response_30m, {Q.r('c')} AS avg_estimated_cost_sgd,
  {Q.r('CASE WHEN c > 0 THEN ben / c ELSE ben END')} AS expected_roi, CASE WHEN n >= 12 THEN 'high' WHEN n >= 6 THEN 'medium' ELSE 'low' END AS confidence_band
 FROM (SELECT *, rr * 2.0::DOUBLE + ir + greatest(s, 0.0::DOUBLE) * 0.1::DOUBLE + greatest(-d, 0.0::DOUBLE) * 5.0::DOUBLE AS ben
  FROM (SELECT *, CASE WHEN n > 0 THEN (rec + 1) / (n + 2) ELSE 0.0::DOUBLE END AS rr, CASE WHEN n > 0 THEN (imp + 1) / (n + 2) ELSE 0.0::DOUBLE END AS ir
   FROM (SELECT *, CASE WHEN followed_resolved > 0 THEN followed_resolved ELSE resolved END AS n, CASE WHEN followed_resolved > 0 THEN f_rec ELSE r_rec END AS rec,
     CASE WHEN followed_resolved > 0 THEN f_imp ELSE r_imp END AS imp, CASE WHEN followed_resolved > 0 THEN f_delta ELSE r_delta END AS d,
     CASE WHEN followed_resolved > 0 THEN f_supply ELSE r_supply END AS s, CASE WHEN followed_resolved > 0 THEN f_cost ELSE r_cost END AS c
    FROM (SELECT {lead}CAST(count(*) AS BIGINT) AS total, CAST(count(outcome) AS BIGINT) AS resolved, {Q.count_if("followed_status = 'followed'")} AS followed,
      {Q.count_if("followed_status IN ('followed', 'not_followed')")} AS known, {Q.count_if("outcome IS NOT NULL AND followed_status = 'followed'")} AS followed_resolved,
      {Q.count_if("outcome IS NOT NULL AND followed_status = 'not_followed'")} AS unfollowed_resolved,
      {picked('f', "outcome IS NOT NULL AND followed_status = 'followed'")}, {picked('r', 'outcome IS NOT NULL')} FROM {source} {group}))))"""


@query("A-15 A-14", Q.with_(Q.OUTCOME_LOG) + effect_sql("olog", "action_type"))
def action_effectiveness(spark, folder):
    return O.effectiveness_by_action(P.outcome_log(spark, folder))


@query("A-14", Q.with_(Q.OUTCOME_LOG) + effect_sql("olog", ""))
def overall_effectiveness(spark, folder):
    return O.effectiveness(P.outcome_log(spark, folder))


@query("A-16", Q.with_(Q.OUTCOME_LOG, "fs AS (SELECT *, coalesce(followed_status, 'unknown') AS follow_state FROM olog)") + effect_sql("fs", "follow_state"))
def follow_status(spark, folder):
    return O.effectiveness_by_follow_status(P.outcome_log(spark, folder))


_CTX = "action_type, risk_level, root_cause, intervention_window"
_CTX_LOG = "cl AS (SELECT * REPLACE (coalesce(intervention_window, 'unknown') AS intervention_window) FROM olog WHERE outcome IS NOT NULL)"


@query("A-17 L-06", Q.with_(Q.OUTCOME_LOG, _CTX_LOG) + f"""SELECT {_CTX}, resolved, recovery_rate, improvement_rate, confidence_band FROM ({effect_sql('cl', _CTX)})
  ORDER BY resolved DESC, improvement_rate DESC, {_CTX} LIMIT 6""")
def top_contexts(spark, folder):
    return O.top_contexts(P.outcome_log(spark, folder))


@query("A-18 L-05", Q.with_(Q.OUTCOME_LOG) + f"""SELECT zone_id, zone_name, CAST(count(*) AS BIGINT) AS interventions,
  {Q.r("avg(CASE WHEN outcome = 'recovered' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS recovery_rate FROM olog WHERE outcome IS NOT NULL GROUP BY 1, 2
  ORDER BY interventions DESC, zone_id LIMIT 10""")
def zone_interventions(spark, folder):
    return O.zone_interventions(P.outcome_log(spark, folder))


_LADDER_SQL = []
for _i, (_keys, _words) in enumerate(O.LADDER):
    _match = " AND ".join(f"l.{k} IS NOT DISTINCT FROM c.{k}" for k in _keys)
    _LADDER_SQL.append(f"SELECT c.cid, {_i} AS rung, '{_words}' AS words, l.* FROM ctx c JOIN olog l ON {_match}")
_WANTED = ", ".join(O.LADDER_KEYS)


@query("A-19", Q.with_(Q.OUTCOME_LOG, f"ctx AS (SELECT row_number() OVER () AS cid, * FROM (SELECT DISTINCT {_WANTED} FROM olog))",
                       "lad AS (SELECT cid, rung, words, outcome, followed_status, score_after, score_at_time, supply_delta_30m, estimated_cost_sgd FROM ("
                       + " UNION ALL ".join(_LADDER_SQL) + "))", f"st AS ({effect_sql('lad', 'cid, rung, words')})",
                       "pick AS (SELECT cid, arg_min({'w': words, 'e': CASE WHEN followed_resolved > 0 THEN followed_resolved ELSE resolved END, 't': total, 'r': resolved, "
                       "'rr': recovery_rate, 'ir': improvement_rate, 'roi': expected_roi, 'b': confidence_band}, CASE WHEN resolved >= 3 THEN rung ELSE rung + 100 END) AS p FROM st GROUP BY 1)")
       + f"""SELECT {_WANTED}, p.t AS total, p.r AS resolved, p.rr AS recovery_rate, p.ir AS improvement_rate, p.roi AS expected_roi, p.e AS evidence_count,
  'Based on ' || p.w || '; ' || CAST(p.e AS VARCHAR) || ' resolved examples, ' || p.b || ' confidence.' AS policy_rank_reason,
  'Expected supply response based on ' || p.w || '.' AS driver_response_reason FROM ctx JOIN pick USING (cid)""")
def context_ladder(spark, folder):
    log = P.outcome_log(spark, folder)
    return O.context_effectiveness(log, log).select(
        *O.LADDER_KEYS, "total", "resolved", "recovery_rate", "improvement_rate", "expected_roi", "evidence_count", "policy_rank_reason", "driver_response_reason")


@query("A-13 X-14", Q.with_(Q.OUTCOME_LOG) + f"""SELECT CAST(count(*) AS BIGINT) AS total_logged, CAST(count(outcome) AS BIGINT) AS total_resolved,
  {Q.r("count(*) FILTER (WHERE outcome = 'recovered') / count(outcome)")} AS recovery_rate, {Q.r("count(*) FILTER (WHERE outcome IN ('recovered', 'improved')) / count(outcome)")} AS improvement_rate,
  {Q.r("count(*) FILTER (WHERE outcome = 'worsened') / count(outcome)")} AS worsened_rate,
  CASE WHEN count(outcome) < 50 THEN 'Note: ' || CAST(count(outcome) AS VARCHAR) || ' resolved outcomes — directional signal only.' ELSE '' END AS sample_size_note FROM olog""")
def outcome_rates(spark, folder):
    rates = O.outcome_rates(P.outcome_log(spark, folder))
    return rates.withColumn("sample_size_note", T.sample_size_note("total_resolved"))


@query("L-08", Q.with_(Q.OUTCOME_LOG) + """SELECT recommendation_id, zone_id, action_type, score_at_time, score_after, outcome, logged_at, coalesce(followed_status, 'unknown') AS followed_status
  FROM olog WHERE outcome IS NOT NULL ORDER BY logged_at DESC, recommendation_id LIMIT 20""")
def recent_outcomes(spark, folder):
    return O.recent_outcomes(P.outcome_log(spark, folder))


_PIVOT = ", ".join(f"{Q.count_if(f"outcome = '{o}'")} AS {o}" for o in ("recovered", "improved", "unchanged", "worsened"))


@query("A-20", Q.with_(Q.OUTCOME_LOG) + f"SELECT action_type, {_PIVOT} FROM olog WHERE outcome IS NOT NULL GROUP BY 1")
def outcome_pivot(spark, folder):
    return O.outcome_counts(P.outcome_log(spark, folder))


@query("A-20", Q.with_(Q.OUTCOME_LOG) + f"""SELECT action_type, {_PIVOT} FROM (SELECT * FROM olog WHERE logged_at > (SELECT max(logged_at) FROM olog) - INTERVAL 365 DAY)
  WHERE outcome IS NOT NULL GROUP BY 1""")
def outcome_summary(spark, folder):
    """The summary of the last year."""
    return O.outcome_counts(P.outcome_log(spark, folder), days=365)


_BUCKET = "CASE WHEN CAST('0x' || left(sha1(CAST(zone_id AS VARCHAR) || '|' || strftime(logged_at, '%Y-%m-%d %H:%M:%S')), 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.1::DOUBLE THEN 'holdout' ELSE 'treatment' END"


def _bucketed(spark, folder):
    stamp = F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss")
    return P.outcome_log(spark, folder).withColumn("evaluation_bucket", T.holdout_bucket("zone_id", stamp))


@query("M-30", Q.with_(Q.OUTCOME_LOG) + f"SELECT recommendation_id, {_BUCKET} AS evaluation_bucket FROM olog")
def holdout_buckets(spark, folder):
    return _bucketed(spark, folder).select("recommendation_id", "evaluation_bucket")


@query("A-21", Q.with_(Q.OUTCOME_LOG) + f"""SELECT treatment_count, holdout_count, {Q.r('t')} AS treatment_recovery_rate, {Q.r('h')} AS holdout_recovery_rate, {Q.r('t - h')} AS recovery_rate_gap
  FROM (SELECT {Q.count_if("b = 'treatment'")} AS treatment_count, {Q.count_if("b = 'holdout'")} AS holdout_count,
   coalesce(avg(CASE WHEN outcome = 'recovered' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE b = 'treatment'), 0) AS t,
   coalesce(avg(CASE WHEN outcome = 'recovered' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE b = 'holdout'), 0) AS h FROM (SELECT *, {_BUCKET} AS b FROM olog))""")
def treatment_gap(spark, folder):
    return O.treatment_gap(_bucketed(spark, folder))


def issued_records(spark, folder):
    """Orders as open recommendations."""
    o = table(use_utc(spark), folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("recommendation_id"), F.col("o_custkey").alias("zone_id"), ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("score_at_time"),
        (F.col("o_orderkey") % 40).cast("int").alias("supply_at_time"), (F.col("o_orderdate").cast("timestamp") + F.make_interval(mins=F.lit(30))).alias("check_after"))


_NOW_SCORES = """cur AS (SELECT l_partkey AS zone_id, arg_max({'s': l_discount * 10, 'q': l_quantity}, {'d': l_shipdate, 'k': l_orderkey, 'n': l_linenumber}) AS c FROM lineitem GROUP BY 1)"""


@query("J-12 M-26", Q.with_(_NOW_SCORES) + f"""SELECT recommendation_id, zone_id, {Q.OUTCOME} AS outcome, score_after, supply_after_30m, supply_delta_30m FROM (
  SELECT o_orderkey AS recommendation_id, o_custkey AS zone_id, (o_orderkey % 100) / 100.0::DOUBLE AS score_at_time, {Q.r('c.s')} AS score_after,
   CAST(c.q AS INTEGER) AS supply_after_30m, CAST(c.q - o_orderkey % 40 AS INTEGER) AS supply_delta_30m FROM orders JOIN cur ON cur.zone_id = o_custkey
  WHERE o_orderdate + INTERVAL 30 MINUTE <= TIMESTAMP '1999-01-01')""")
def resolve_outcomes(spark, folder):
    at = F.lit("1999-01-01").cast("timestamp")
    li = table(spark, folder, "lineitem")
    current = li.select(F.col("l_partkey").alias("zone_id"), round_even(F.col("l_discount") * 10).alias("delay_risk_score"),
                        F.col("l_quantity").alias("taxi_count"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("timestamp"))
    return O.resolve(issued_records(spark, folder), current, at).select(
        "recommendation_id", "zone_id", "outcome", "score_after", "supply_after_30m", "supply_delta_30m")


@query("J-13", """SELECT recommendation_id, arg_max(followed_status, {'t': followed_at, 's': followed_status}) AS followed_status, max(followed_at) AS followed_at FROM (
  SELECT l_orderkey AS recommendation_id, l_shipdate AS followed_at, CASE l_returnflag WHEN 'A' THEN 'followed' WHEN 'R' THEN 'not_followed' ELSE 'later' END AS followed_status FROM lineitem)
  WHERE followed_status <> 'later' GROUP BY 1""")
def latest_feedback(spark, folder):
    li = table(use_utc(spark), folder, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", " Followed ").when(F.col("l_returnflag") == "R", "NOT_followed").otherwise("later")
    rows = li.select(F.col("l_orderkey").alias("recommendation_id"), status.alias("followed_status"), F.col("l_shipdate").cast("timestamp").alias("followed_at"),
                     F.col("l_linestatus").alias("followed_by"), F.lit(None).cast("string").alias("follow_note"))
    return O.latest_feedback(rows).select("recommendation_id", "followed_status", "followed_at")


# --- drift ------------------------------------------------------------------

_SPLIT = "1998-06-01"
_DRIFTED = ("l_quantity", "l_extendedprice", "l_discount")


def _halves(spark, folder):
    li = table(use_utc(spark), folder, "lineitem")
    cut = F.lit(_SPLIT).cast("timestamp_ntz")
    return li.filter(F.col("l_shipdate") < cut), li.filter(F.col("l_shipdate") >= cut)


_PSI_SQL = f"""tall AS (SELECT feature, v, cur FROM (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c, l_shipdate >= TIMESTAMP '{_SPLIT}' AS cur FROM lineitem) t,
  LATERAL (VALUES ('l_quantity', a), ('l_extendedprice', b), ('l_discount', c)) u(feature, v)),
span AS (SELECT feature, min(v) AS lo, max(v) AS hi, {Q.count_if('NOT cur')} AS n0, {Q.count_if('cur')} AS n1 FROM tall GROUP BY 1),
guess AS (SELECT t.feature, t.v, t.cur, s.lo, (s.hi - s.lo) / 10.0::DOUBLE AS step, least(floor((t.v - s.lo) / ((s.hi - s.lo) / 10.0::DOUBLE)), 9) AS g FROM tall t JOIN span s USING (feature)),
lower AS (SELECT *, g - CASE WHEN v < lo + g * step THEN 1 ELSE 0 END AS d FROM guess),
cell AS (SELECT feature, d + CASE WHEN d < 9 AND v >= lo + (d + 1) * step THEN 1 ELSE 0 END AS bin, {Q.count_if('NOT cur')} AS c0, {Q.count_if('cur')} AS c1 FROM lower GROUP BY 1, 2),
psi AS (SELECT feature, greatest(sum((a - e) * ln(a / e)), 0.0::DOUBLE) AS psi FROM (SELECT feature, greatest(c0 / n0, 1e-6::DOUBLE) AS e, greatest(c1 / n1, 1e-6::DOUBLE) AS a FROM cell JOIN span USING (feature)) GROUP BY 1)"""
_LEVEL = "CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'warning' ELSE 'alert' END"


@query("A-22", Q.with_(_PSI_SQL) + f"SELECT feature, {Q.r('psi')} AS psi, n0 AS n_ref, n1 AS n_cur FROM psi JOIN span USING (feature)")
def psi_scores(spark, folder):
    ref, cur = _halves(spark, folder)
    p = DR.psi(DR.stacked(ref, _DRIFTED), DR.stacked(cur, _DRIFTED))
    return p.select("feature", round_even("psi").alias("psi"), "n_ref", "n_cur")


@query("A-23 A-24 M-25", Q.with_(_PSI_SQL) + f"""SELECT p.feature, {Q.r('psi')} AS psi, {_LEVEL} AS drift_level, psi > 0.25 AS drift_flag, {Q.r('m0', 2)} AS reference_mean, {Q.r('m1', 2)} AS current_mean,
  {Q.r('s0', 2)} AS reference_std, {Q.r('s1', 2)} AS current_std, CASE WHEN psi > 0.25 THEN 'DRIFT_ALERT' WHEN psi > 0.10 THEN 'DRIFT_WARNING' ELSE '' END AS alert_id
  FROM psi p JOIN (SELECT feature, avg(v) FILTER (WHERE NOT cur) AS m0, avg(v) FILTER (WHERE cur) AS m1, stddev_samp(v) FILTER (WHERE NOT cur) AS s0, stddev_samp(v) FILTER (WHERE cur) AS s1
    FROM tall GROUP BY 1) USING (feature)""")
def psi_features(spark, folder):
    ref, cur = _halves(spark, folder)
    rep = DR.feature_drift(ref, cur, _DRIFTED)
    two = {c: round_even(c, 2) for c in ("reference_mean", "current_mean", "reference_std", "current_std")}
    return rep.withColumns(two).select("feature", "psi", "drift_level", "drift_flag", *two, "alert_id")


_SHIFTED = f"""tall AS (SELECT 'delay_risk_score' AS feature, l_discount * 10 AS v, false AS cur FROM lineitem UNION ALL SELECT 'delay_risk_score', l_tax * 10, true FROM lineitem),
{_PSI_SQL[_PSI_SQL.index("span AS"):]}"""


@query("A-23 S-15", Q.with_(_SHIFTED) + f"""SELECT CASE WHEN psi > 0.25 THEN 'DRIFT_ALERT' ELSE 'DRIFT_WARNING' END AS alert_id, CASE WHEN psi > 0.25 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN psi > 0.25 THEN 'Prediction drift detected — PSI=' || printf('%.3f', {Q.r('psi')}) ELSE 'Moderate drift detected — PSI=' || printf('%.3f', {Q.r('psi')}) || ', level=warning' END AS message FROM psi WHERE psi > 0.10""")
def drift_alert_rows(spark, folder):
    """All discounts as the reference and all taxes as the current scores: what alert their distance raises, logged and read back."""
    at = scratch_path(spark, "alerts")
    li = table(use_utc(spark), folder, "lineitem")
    scores = lambda c: li.select((F.col(c) * F.lit(10)).alias("delay_risk_score"))
    alerts = DR.drift_alerts(DR.score_drift(scores("l_discount"), scores("l_tax")), None, P.now())
    WR.append_log(alerts, at, now=P.now())
    return R.read_json_lines(spark, at, "alert_id string, severity string, message string, logged_at string").select("alert_id", "severity", "message")


@query("A-25", " UNION ALL ".join(f"""SELECT '{c}' AS feature, {Q.r(f'avg({c})', 2)} AS mean_value, {Q.r(f'stddev_samp({c})', 2)} AS std_value, CAST(count({c}) AS BIGINT) AS n FROM lineitem""" for c in _DRIFTED))
def feature_snapshot(spark, folder):
    snap = DR.feature_snapshot(table(spark, folder, "lineitem"), _DRIFTED)
    return snap.withColumns({c: round_even(c, 2) for c in ("mean_value", "std_value")})


@query("A-25", " UNION ALL ".join(f"""SELECT '{c}' AS feature, {Q.r(f'CAST({c} AS DOUBLE)', 6)} AS value, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 2""" for c in ("l_quantity", "l_discount")))
def feature_sample(spark, folder):
    """What is stored of each feature for the next PSI: its values and how often they occur."""
    return DR.feature_counts(table(spark, folder, "lineitem"), ("l_quantity", "l_discount"))


@query("A-07", Q.with_(*Q.TO_SCORED) + f"""SELECT {Q.r('avg(delay_risk_score)')} AS score_mean, {Q.r('stddev_pop(delay_risk_score)')} AS score_std, {Q.r('quantile_cont(delay_risk_score, 0.5)')} AS score_p50,
  {Q.r('quantile_cont(delay_risk_score, 0.9)')} AS score_p90, {Q.r('avg(CASE WHEN delay_risk_score >= 0.7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS pct_high_risk,
  CAST(count(*) AS BIGINT) AS n_scored FROM scored""")
def score_stats(spark, folder):
    return SC.score_stats(P.scored(spark, folder))


@query("A-07", Q.with_(*Q.TO_SCORED) + f"SELECT {Q.r('delay_risk_score', 6)} AS score, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1")
def score_sample(spark, folder):
    """The drift reference: all scores and how often they occur."""
    return SC.score_counts(P.scored(spark, folder))


@query("M-28 A-41", Q.with_(Q.RUNS) + f"""SELECT run_id, coalesce(rate > 0.20::DOUBLE, false) OR psi > 0.25 OR drift_flag AS should_rollback,
  CASE WHEN rate > 0.20::DOUBLE THEN 'failed row pct ' || printf('%.1f', {Q.r('rate * 100.0::DOUBLE', 1)}) || '% > 20%'
   WHEN psi > 0.25 OR drift_flag THEN 'PSI drift ' || printf('%.3f', psi) || ' > 0.25' ELSE '' END AS rollback_reason
  FROM (SELECT *, CASE WHEN rows_scored > 0 THEN failed_rows / (rows_scored + failed_rows) END AS rate FROM runs)""")
def rollback_rule(spark, folder):
    return DR.rollback_rule(P.runs(spark, folder)).select("run_id", "should_rollback", "rollback_reason")


@query("A-41", Q.with_(Q.RUNS) + f"""SELECT timestamp AS created_at, 'HIGH_FAILED_ROWS' AS alert_id, CAST(failed_rows AS VARCHAR) || ' rows failed validation in latest batch (' ||
  CAST(CAST(round_even(failed_rows / greatest(rows_scored, 1) * 100.0::DOUBLE, 0) AS INTEGER) AS VARCHAR) || '%)' AS message FROM runs WHERE failed_rows / greatest(rows_scored, 1) > 0.10::DOUBLE""")
def failed_row_alerts(spark, folder):
    return DR.failed_row_alerts(P.runs(spark, folder)).select("created_at", "alert_id", "message")


# --- classifier quality -----------------------------------------------------

_CURVE = """pc AS (SELECT p AS s, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS neg FROM lab GROUP BY 1),
cv AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, (SELECT sum(pos) FROM pc) AS np, (SELECT sum(neg) FROM pc) AS nn FROM pc),
cf AS (SELECT *, CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (tp + fp + np) ELSE 0.0::DOUBLE END AS f1 FROM cv)"""


@query("A-26 A-27", Q.with_(Q.LABELLED, _CURVE) + f"""SELECT {Q.r('b.s')} AS best_threshold, {Q.r('b.tp / (b.tp + b.fp)')} AS "precision", {Q.r('b.tp / b.np')} AS recall, {Q.r('b.f1')} AS f1,
  CAST(b.tp AS BIGINT) AS tp, CAST(b.fp AS BIGINT) AS fp, CAST(b.np - b.tp AS BIGINT) AS fn, CAST(b.nn - b.fp AS BIGINT) AS tn, {Q.r('(b.tp + b.fp) / (b.np + b.nn)')} AS pct_above_threshold,
  {Q.r('(SELECT sum(neg * (tp - pos / 2.0::DOUBLE)) FROM cv) / (b.np * b.nn)')} AS roc_auc, {Q.r('(SELECT sum(pos / np * (tp / (tp + fp))) FROM cv)')} AS average_precision,
  (SELECT {Q.r('avg(abs(p - y))')} FROM lab) AS mae, (SELECT {Q.r('sqrt(avg((p - y) * (p - y)))')} FROM lab) AS rmse, (SELECT {Q.r('avg(p)')} FROM lab) AS pred_mean,
  (SELECT {Q.r('stddev_pop(p)')} FROM lab) AS pred_std, (SELECT CAST(count(*) AS BIGINT) FROM lab) AS n_test, (SELECT {Q.r('avg(y)')} FROM lab) AS positive_rate
  FROM (SELECT * FROM cf ORDER BY f1 DESC, s LIMIT 1) b""")
def best_f1_threshold(spark, folder):
    return M.evaluate(P.labelled(spark, folder))


@query("A-29", Q.with_(Q.LABELLED, _CURVE) + f"SELECT {Q.r('sum(pos / np * (tp / (tp + fp)))')} AS average_precision FROM cv")
def average_precision(spark, folder):
    return M.ranking_quality(P.labelled(spark, folder)).select("average_precision")


@query("A-26", Q.with_(Q.LABELLED) + " UNION ALL ".join(f"""SELECT source, {Q.r('sum(n0 * (tp - p1 / 2.0::DOUBLE)) / (max(a1) * max(a0))')} AS roc_auc FROM (
  SELECT *, sum(p1) OVER (PARTITION BY source ORDER BY p DESC) AS tp, sum(p1) OVER (PARTITION BY source) AS a1, sum(n0) OVER (PARTITION BY source) AS a0 FROM (
   SELECT source, p, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS p1, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS n0 FROM lab GROUP BY 1, 2)) GROUP BY 1""" for _ in (0,)))
def auc_by_source(spark, folder):
    return M.ranking_quality(P.labelled(spark, folder), groups=["source"]).select("source", "roc_auc")


def _sweep_row(t: float) -> str:
    tp, fp, fn = (Q.count_if(c) for c in (f"p >= {t}::DOUBLE AND y = 1", f"p >= {t}::DOUBLE AND y = 0", f"p < {t}::DOUBLE AND y = 1"))
    return f"SELECT {t}::DOUBLE AS threshold, {tp} AS tp, {fp} AS fp, {fn} AS fn FROM lab"


@query("A-28 L-12", Q.with_(Q.LABELLED) + f"""SELECT threshold, {Q.r('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END')} AS "precision", {Q.r('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END')} AS recall,
  {Q.r('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END')} AS f1, fn AS missed, fp AS false_alarms, tp + fp AS predicted_positives FROM ({' UNION ALL '.join(_sweep_row(t) for t in M.SWEEP)})""")
def threshold_sweep(spark, folder):
    return M.threshold_sweep(P.labelled(spark, folder))


@query("L-12", Q.with_(Q.LABELLED) + f"""SELECT threshold, {Q.r('2 * tp / (2 * tp + fp + fn)')} AS f1 FROM ({' UNION ALL '.join(_sweep_row(t) for t in M.SWEEP)}) ORDER BY f1 DESC, threshold LIMIT 1""")
def best_sweep_row(spark, folder):
    return M.best_row(M.threshold_sweep(P.labelled(spark, folder)), "f1", ["threshold"]).select("threshold", "f1")


@query("A-30", Q.with_(Q.LABELLED) + f"""SELECT CAST(least(greatest(1, ceil(p * 10.0::DOUBLE)), 10) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, {Q.r('avg(p)')} AS mean_predicted, {Q.r('avg(y)')} AS fraction_positive FROM lab GROUP BY 1""")
def calibration_bins(spark, folder):
    return M.calibration(P.labelled(spark, folder))


@query("A-30", Q.with_(Q.LABELLED) + f"SELECT {Q.r('avg((p - y) * (p - y))')} AS brier_score FROM lab")
def brier_score(spark, folder):
    return M.brier(P.labelled(spark, folder))


_ERR = """err AS (SELECT *, CASE WHEN y = 1 AND p >= 0.05::DOUBLE THEN 'TP' WHEN y <> 1 AND p >= 0.05::DOUBLE THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS e FROM lab)"""


def _errors(spark, folder):
    return M.with_error_type(P.labelled(spark, folder), threshold=0.05)


@query("A-31", Q.with_(Q.LABELLED, _ERR) + f"""SELECT tp, fp, fn, tn, {Q.r('fn / greatest(fn + tp, 1)')} AS miss_rate, {Q.r('fp / greatest(fp + tn, 1)')} AS false_alarm_rate FROM (
  SELECT {", ".join(f"{Q.count_if(f"e = '{k}'")} AS {k.lower()}" for k in ("TP", "FP", "FN", "TN"))} FROM err)""")
def error_breakdown(spark, folder):
    return M.error_breakdown(_errors(spark, folder))


def _err_group(c: str) -> str:
    return f"""SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS member, CAST(count(*) AS BIGINT) AS n, {Q.count_if('y = 1')} AS positives, {Q.count_if("e = 'TP'")} AS caught,
  {Q.count_if("e = 'FN'")} AS missed, {Q.count_if("e = 'FP'")} AS false_alarms, {Q.r("count(*) FILTER (WHERE e = 'FN') / greatest(count(*) FILTER (WHERE y = 1), 1)")} AS fn_rate,
  {Q.r("count(*) FILTER (WHERE e = 'FP') / greatest(count(*) FILTER (WHERE y = 0), 1)")} AS fp_rate, {Q.r('avg(y)')} AS base_rate, {Q.r("avg(p) FILTER (WHERE e = 'FN')")} AS avg_prob_fn FROM err GROUP BY {c}"""


_ERR_DIMS = ("lang", "source", "toxic")


@query("A-32", Q.with_(Q.LABELLED, _ERR) + " UNION ALL ".join(_err_group(c) for c in _ERR_DIMS))
def error_by_group(spark, folder):
    return M.error_by_groups(_errors(spark, folder), list(_ERR_DIMS))


@query("L-11", Q.with_(Q.LABELLED, _ERR) + f"SELECT dimension, member, positives, fn_rate FROM ({' UNION ALL '.join(_err_group(c) for c in _ERR_DIMS)}) WHERE positives >= 5 ORDER BY fn_rate DESC, dimension, member LIMIT 15")
def hardest_groups(spark, folder):
    return M.hardest_groups(M.error_by_groups(_errors(spark, folder), list(_ERR_DIMS))).select("dimension", "member", "positives", "fn_rate")


@query("A-33", Q.with_(Q.LABELLED, _ERR) + f"""SELECT feature, {Q.r('t')} AS tp_mean, {Q.r('f')} AS fn_mean, {Q.r('f - t')} AS difference, abs(f - t) > 0.1::DOUBLE * abs(t + 1e-9::DOUBLE) AS marked FROM (
  SELECT feature, avg(v) FILTER (WHERE e = 'TP') AS t, avg(v) FILTER (WHERE e = 'FN') AS f FROM (SELECT e, n_chars, toxic FROM err) x,
  LATERAL (VALUES ('n_chars', CAST(n_chars AS DOUBLE)), ('toxic', CAST(toxic AS DOUBLE))) u(feature, v) GROUP BY 1)""")
def missed_vs_caught(spark, folder):
    return M.missed_vs_caught(_errors(spark, folder), ["n_chars", "toxic"])


@query("M-25", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 3 >= 0.25::DOUBLE THEN 'significant' WHEN l_discount * 3 >= 0.10::DOUBLE THEN 'moderate' ELSE 'stable' END AS psi_level,
  CASE WHEN l_discount * 3 < 0.10::DOUBLE THEN 'stable' WHEN l_discount * 3 < 0.25::DOUBLE THEN 'warning' ELSE 'alert' END AS drift_level FROM lineitem""")
def drift_labels(spark, folder):
    psi = F.col("l_discount") * 3
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.psi_level(psi).alias("psi_level"), X.drift_level(psi).alias("drift_level"))
