"""Persistence, cooldown, surplus, budget, actions and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.functions import text as T
from zonetide.operators import cards as C
from zonetide.operators import decision as D
from zonetide.plans import proxies as P
from zonetide.plans import sql as Q
from zonetide.plans.catalogue import query
from zonetide.session import use_utc, written
from zonetide.settings import ACTIONS, CANDIDATES, DecisionSettings
from zonetide.sources.readers import table

KEY = ("zone_id", "timestamp")
SMALL_BUDGET = DecisionSettings(daily_budget=10.0)

_RUN_SQL = """islands AS (SELECT *, CAST(predicted_shortage > 0.25 AS INTEGER) AS hit, sum(CASE WHEN predicted_shortage > 0.25 THEN 0 ELSE 1 END)
   OVER (PARTITION BY zone_id ORDER BY timestamp) AS island FROM scored),
counted AS (SELECT *, CAST(sum(hit) OVER (PARTITION BY zone_id, island ORDER BY timestamp) AS INTEGER) AS persistence_count FROM islands)"""


def _over():
    return F.col("predicted_shortage") > 0.25


@query("W-12", Q.with_(*Q.TO_SCORED, _RUN_SQL) + "SELECT zone_id, timestamp, persistence_count FROM counted")
def persistence_counter(spark, folder):
    return D.persistence_counts(P.scored(spark, folder), _over()).select(*KEY, "persistence_count")


@query("W-12", Q.with_(*Q.TO_SCORED, _RUN_SQL) + "SELECT zone_id, timestamp, persistence_count FROM counted")
def persistence_counter_long_series(spark, folder):
    return D.persistence_counts(P.scored(spark, folder), _over(), range_rows=500).select(*KEY, "persistence_count")


@query("W-12", Q.with_(*Q.TO_SCORED, _RUN_SQL) + """SELECT zone_id, timestamp, CAST(persistence_count + CASE WHEN island = 0 THEN zone_id * 10 ELSE 0 END AS INTEGER) AS persistence_count FROM counted""")
def persistence_counter_carried(spark, folder):
    carried = P.zone_dimension(spark).select("zone_id", (F.col("zone_id") * 10).alias("carried_count"))
    return D.persistence_counts(P.scored(spark, folder), _over(), carried=carried).select(*KEY, "persistence_count")


_EVENT_ACTION = {"click": "monitor", "view": "rebalance", "purchase": "incentive", "signup": "rebalance_plus_incentive", "error": "ops_alert"}


@query("W-18 N-02", """SELECT zone_id, """ + ", ".join(
    f"coalesce(date_diff('second', max(ts) FILTER (WHERE event_type = '{e}'), {Q.NOW_SQL}) < {a.cooldown_minutes * 60}, false) AS cooling_{a.name}"
    if a.cooldown_minutes else f"false AS cooling_{a.name}" for e, name in _EVENT_ACTION.items() for a in ACTIONS if a.name == name)
    + " FROM (SELECT user_id % 5 + 1 AS zone_id, ts, event_type FROM events) GROUP BY 1")
def cooldown_flags(spark, folder):
    action = F.create_map(*[F.lit(x) for pair in _EVENT_ACTION.items() for x in pair])
    log = P.events(spark, folder).select("zone_id", action[F.col("event_type")].alias("action"), F.date_trunc("second", "ts").alias("acted_at"))
    # Whole seconds on both sides keep the comparison independent of how fractions are cut.
    return D.with_cooldowns(P.zone_dimension(spark).select("zone_id"), D.last_actions(log), P.now())


def decision_rows(spark, folder):
    """Every zone-hour with run length and neighbour surplus. Stored in between, because the surplus reads the rows twice."""
    counted = written(D.persistence_counts(P.scored(spark, folder), _over()), "counted")
    return D.with_neighbor_surplus(counted, P.ring(spark))


def stored_rows(spark, folder):
    """The same as a stored table: the budget reads it several times."""
    return written(decision_rows(spark, folder).withColumn("day", F.to_date("timestamp")), "decision-rows")


_SPARE = "greatest(taxi_count - greatest(greatest(baseline_supply, 1.0::DOUBLE) * 0.8::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) / greatest(baseline_supply, 1.0::DOUBLE)"
_ACTS = "acts(rnk, action, cost, uplift, boost, spends, needs, free) AS (VALUES " + ", ".join(
    f"({i}, '{a.name}', {a.cost}::DOUBLE, {a.uplift}::DOUBLE, {a.boost}::DOUBLE, {str(a.spends_budget).lower()}, {str(a.needs_surplus).lower()}, {str(a.always_allowed).lower()})"
    for i, a in enumerate(ACTIONS)) + ")"
_CANDS = "cands(sev, cact) AS (VALUES " + ", ".join(f"('{s}', '{a}')" for s, names in CANDIDATES.items() for a in names) + ")"
_GAIN = Q.r("greatest(0.0::DOUBLE, least(greatest(predicted_shortage, 0.0::DOUBLE) * uplift * (CASE WHEN needs THEN least(greatest(neighbor_surplus, 0.0::DOUBLE), 1.0::DOUBLE) "
            "ELSE 1.0::DOUBLE END) * boost, greatest(predicted_shortage, 0.0::DOUBLE)))")
_ROWS_SQL = f"""spare AS (SELECT r.zone, {Q.r(f'sum({_SPARE})')} AS ns FROM ring r JOIN (SELECT zone_name, arg_max(taxi_count, timestamp) AS taxi_count,
   arg_max(baseline_supply, timestamp) AS baseline_supply FROM scored GROUP BY 1) s ON s.zone_name = r.neighbor GROUP BY 1),
drows AS (SELECT c.*, coalesce(sp.ns, 0.0) AS neighbor_surplus, {Q.SEVERITY} AS severity_bucket FROM counted c LEFT JOIN spare sp ON sp.zone = c.zone_name),
options AS (SELECT *, {Q.r("shortage_reduction * 1.0::DOUBLE - cost * 0.35::DOUBLE - (CASE WHEN action = 'ops_alert' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END)")} AS net_value,
   (free OR persistence_count >= 2) AND (NOT needs OR neighbor_surplus > 0) AS ok
  FROM (SELECT d.*, a.*, {_GAIN} AS shortage_reduction FROM drows d JOIN cands k ON k.sev = d.severity_bucket JOIN acts a ON a.action = k.cact))"""
_TO_OPTIONS = (*Q.TO_SCORED, Q.RING, _RUN_SQL, _ACTS, _CANDS, _ROWS_SQL)


@query("N-01 N-02 M-22", Q.with_(*_TO_OPTIONS) + """SELECT zone_id, timestamp, severity_bucket, action, cost AS action_cost, shortage_reduction, net_value, ok AS feasible,
  concat_ws('; ', CASE WHEN needs AND NOT neighbor_surplus > 0 THEN 'neighbor_surplus_unavailable' END,
    CASE WHEN NOT free AND persistence_count < 2 THEN 'persistence_requirement' END) AS obstacles FROM options""")
def candidate_actions(spark, folder):
    return D.candidate_actions(decision_rows(spark, folder)).select(
        *KEY, "severity_bucket", "action", "action_cost", "shortage_reduction", "net_value", "feasible", "obstacles")


_BEST_SQL = """best AS (SELECT d.*, coalesce(b.action, CASE WHEN severity_bucket = 'severe' THEN 'ops_alert' ELSE 'monitor' END) AS recommended_action, b.action IS NULL AS fallback
  FROM drows d LEFT JOIN (SELECT zone_id, timestamp, arg_max(action, {'n': net_value, 'r': -rnk}) AS action FROM options WHERE ok GROUP BY 1, 2) b USING (zone_id, timestamp))"""
_PRICED_SQL = f"""priced AS (SELECT b.*, a.cost AS estimated_action_cost, {_GAIN} AS estimated_shortage_reduction FROM best b JOIN acts a ON a.action = b.recommended_action)"""
_WHY = """CASE WHEN NOT fallback THEN 'Selected ' || recommended_action || ' because it maximized deterministic net value under current constraints.'
  WHEN recommended_action = 'ops_alert' THEN 'No automated action was feasible under current constraints.' ELSE 'Constraints blocked active intervention; continue monitoring.' END"""
_TRIGGERED = """CASE WHEN NOT fallback THEN '[]' WHEN severity_bucket = 'low' THEN '[]' WHEN neighbor_surplus > 0 THEN '["persistence_requirement"]'
  ELSE '["neighbor_surplus_unavailable", "persistence_requirement"]' END"""


def _decided(spark, folder):
    rows = decision_rows(spark, folder).withColumn("remaining_budget", F.lit(30.0))
    return D.decide(rows)


@query("N-03 X-10", Q.with_(*_TO_OPTIONS, _BEST_SQL, _PRICED_SQL) + f"""SELECT zone_id, timestamp, severity_bucket, recommended_action, {_WHY} AS action_reason,
  estimated_action_cost, estimated_shortage_reduction, {Q.r("CASE WHEN recommended_action IN ('incentive', 'rebalance_plus_incentive') THEN 30.0::DOUBLE - estimated_action_cost ELSE 30.0::DOUBLE END")} AS budget_remaining,
  {_TRIGGERED} AS constraints_triggered FROM priced""")
def best_action(spark, folder):
    return _decided(spark, folder).select(*KEY, "severity_bucket", "recommended_action", "action_reason", "estimated_action_cost",
                                          "estimated_shortage_reduction", "budget_remaining", "constraints_triggered")


_PICKS = ", ".join(
    f"arg_max(action, {{'n': net_value, 'r': -rnk}}) FILTER (WHERE ok AND (action <> 'incentive' OR {i}) AND (action <> 'rebalance_plus_incentive' OR {b})) AS p{int(i == 'true')}{int(b == 'true')}"
    for i in ("true", "false") for b in ("true", "false"))


def _replay_sql(group: str, in_run: bool) -> str:
    """Row by row, the way a single process would do it."""
    blocked_i = "(s.mi >> z.zone_id) & 1 = 1" if in_run else "false"
    blocked_b = "(s.mb >> z.zone_id) & 1 = 1" if in_run else "false"
    left = "greatest(s.budget - CASE s.took WHEN 'incentive' THEN 1.5::DECIMAL(12,4) WHEN 'rebalance_plus_incentive' THEN 2.1::DECIMAL(12,4) ELSE 0::DECIMAL(12,4) END, 0::DECIMAL(12,4))"
    mi = "s.mi | CASE WHEN s.took = 'incentive' THEN (1 << CAST(s.zone_id AS INTEGER)) ELSE 0 END"
    mb = "s.mb | CASE WHEN s.took = 'rebalance_plus_incentive' THEN (1 << CAST(s.zone_id AS INTEGER)) ELSE 0 END"
    take = f"""CASE WHEN budget >= 1.5 AND NOT bi AND budget >= 2.1 AND NOT bb THEN p11 WHEN budget >= 1.5 AND NOT bi THEN p10 WHEN budget >= 2.1 AND NOT bb THEN p01 ELSE p00 END"""
    return "WITH RECURSIVE " + ",\n".join((*_TO_OPTIONS, f"""picks AS (SELECT zone_id, timestamp, {_PICKS} FROM options GROUP BY 1, 2),
queue AS MATERIALIZED (SELECT d.zone_id, d.timestamp, d.severity_bucket, {group} AS grp, row_number() OVER (PARTITION BY {group} ORDER BY d.zone_id, d.timestamp) AS rn,
   p11, p10, p01, p00 FROM drows d LEFT JOIN picks p ON p.zone_id = d.zone_id AND p.timestamp = d.timestamp),
st AS (SELECT grp, CAST(0 AS BIGINT) AS rn, CAST(10 AS DECIMAL(12,4)) AS budget, CAST(NULL AS VARCHAR) AS took, CAST(0 AS BIGINT) AS zone_id, CAST(NULL AS TIMESTAMP) AS timestamp,
   CAST(NULL AS VARCHAR) AS severity_bucket, 0 AS mi, 0 AS mb FROM queue GROUP BY grp
  UNION ALL
  SELECT grp, rn, budget, {take} AS took, zone_id, timestamp, severity_bucket, mi, mb FROM (
   SELECT z.grp, z.rn, CAST({left} AS DECIMAL(12,4)) AS budget, z.zone_id, z.timestamp, z.severity_bucket, p11, p10, p01, p00, {mi} AS mi, {mb} AS mb,
    ({mi}) >> CAST(z.zone_id AS INTEGER) & 1 = 1 AND {str(in_run).lower()} AS bi, ({mb}) >> CAST(z.zone_id AS INTEGER) & 1 = 1 AND {str(in_run).lower()} AS bb
   FROM st s JOIN queue z ON z.grp = s.grp AND z.rn = s.rn + 1))""")) + """
SELECT zone_id, timestamp, CAST(budget AS DOUBLE) AS remaining_budget, coalesce(took, CASE WHEN severity_bucket = 'severe' THEN 'ops_alert' ELSE 'monitor' END) AS recommended_action
FROM st WHERE rn > 0"""


@query("N-05 N-06", _replay_sql("CAST(d.timestamp AS DATE)", False))
def budget_fold(spark, folder):
    """A budget of 10 per day shared by all zone-hours of the day, in zone order."""
    rows = stored_rows(spark, folder)
    funded = D.allocate_budget(rows, ["day"], ["zone_id", "timestamp"], cfg=SMALL_BUDGET)
    return D.decide(funded, SMALL_BUDGET).select(*KEY, "remaining_budget", "recommended_action")


@query("N-05 N-06 W-18", _replay_sql("CAST(d.timestamp AS DATE)", True))
def budget_fold_with_cooldown(spark, folder):
    """The same, with a zone's incentives blocked for the rest of the run once taken."""
    rows = stored_rows(spark, folder)
    funded = D.allocate_budget(rows, ["day"], ["zone_id", "timestamp"], cfg=SMALL_BUDGET, in_run_cooldown=True)
    return D.decide(funded, SMALL_BUDGET).select(*KEY, "remaining_budget", "recommended_action")


@query("N-05", _replay_sql("0", False))
def budget_fold_one_group(spark, folder):
    """All rows share one budget: the largest group there can be."""
    funded = D.allocate_budget(stored_rows(spark, folder), [], ["zone_id", "timestamp"], cfg=SMALL_BUDGET)
    return D.decide(funded, SMALL_BUDGET).select(*KEY, "remaining_budget", "recommended_action")


@query("N-06", "SELECT grp AS day, " + Q.r("sum(cost)") + " AS spent, " + Q.r("10.0::DOUBLE - sum(cost)") + " AS remaining FROM (SELECT CAST(timestamp AS DATE) AS grp, CASE recommended_action WHEN 'incentive' THEN 1.5::DOUBLE "
       "WHEN 'rebalance_plus_incentive' THEN 2.1::DOUBLE ELSE 0.0::DOUBLE END AS cost FROM (" + _replay_sql("CAST(d.timestamp AS DATE)", False) + ")) GROUP BY 1")
def budget_after_run(spark, folder):
    rows = stored_rows(spark, folder)
    decided = D.decide(D.allocate_budget(rows, ["day"], ["zone_id", "timestamp"], cfg=SMALL_BUDGET), SMALL_BUDGET)
    return D.budget_after(decided, ["day"], SMALL_BUDGET)


@query("N-03 N-05 V-11", Q.with_(*_TO_OPTIONS, _BEST_SQL, _PRICED_SQL) + """SELECT zone_id, timestamp, severity_bucket, persistence_count, neighbor_surplus, recommended_action
  FROM priced WHERE timestamp = (SELECT max(timestamp) FROM priced)""")
def zone_decisions(spark, folder):
    """Decisions for the newest snapshot: five zones, so the daily budget of 30 covers all of them.

    The neighbours' supply is taken from the newest hour when all zones report in it.
    """
    scored = P.scored(spark, folder)
    counted = D.persistence_counts(scored, _over())
    around = D.with_neighbor_surplus(counted, P.ring(spark))
    now_rows = around.filter(F.col("timestamp") == P.newest_hour(spark, folder)).withColumn("day", F.to_date("timestamp"))
    funded = D.allocate_budget(written(now_rows, "decision-rows"), ["day"], ["zone_id", "timestamp"])
    return D.decide(funded).select(*KEY, "severity_bucket", "persistence_count", "neighbor_surplus", "recommended_action")


# --- cards ------------------------------------------------------------------

_PRIORITY = ("CASE WHEN recommended_action = 'ops_alert' THEN 'critical' WHEN severity_bucket IN ('severe', 'high') OR risk_level = 'high' THEN 'high' "
             "WHEN severity_bucket = 'moderate' OR risk_level = 'medium' THEN 'medium' ELSE 'low' END")


def _template(index: int) -> str:
    whens = " ".join(f"WHEN '{a}' THEN replace('{t[index]}', '%s', zone_name)" for a, t in T.ACTION_TEXT.items())
    return f"CASE recommended_action {whens} ELSE replace('{T.MONITOR_TEXT[index]}', '%s', zone_name) END"


_CARD_SQL = f"""card AS (SELECT left(sha1(CAST(zone_id AS VARCHAR) || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '|' || recommended_action), 16) AS recommendation_id,
   zone_id, zone_name, region, timestamp, taxi_count, risk_level, delay_risk_score, demand_pressure_score, imbalance_score, predicted_shortage, severity_bucket,
   persistence_count, neighbor_surplus, recommended_action, {_WHY} AS action_reason, estimated_action_cost, estimated_shortage_reduction,
   upper(left(severity_bucket, 1)) || substr(severity_bucket, 2) || ' shortage stress in ' || zone_name || ' (score ' || printf('%.3f', {Q.r('predicted_shortage', 3)}) || ').' AS issue_detected,
   {_template(0)} AS recommendation, {_template(1)} AS expected_impact,
   {Q.r('least(greatest(delay_risk_score * 0.85::DOUBLE + predicted_shortage * 0.15::DOUBLE, 0.25::DOUBLE), 0.99::DOUBLE)', 2)} AS confidence, {_PRIORITY} AS priority, explanation_tag,
   CASE WHEN explanation_tag LIKE '%rain%' THEN 'weather' WHEN explanation_tag LIKE '%peak%' THEN 'peak_pattern' WHEN demand_pressure_score >= 0.7 THEN 'demand_pressure'
     WHEN depletion_rate_1h > 0.3 THEN 'rapid_depletion' ELSE 'structural_gap' END AS root_cause,
   CASE WHEN recommended_action IN ('rebalance', 'rebalance_plus_incentive') THEN 'Rebalance depends on adjacent exportable surplus.' ELSE '' END AS network_warning,
   CASE WHEN recommended_action IN ('incentive', 'rebalance_plus_incentive') THEN 'targeted' ELSE 'none' END AS incentive_level,
   {Q.r('estimated_shortage_reduction * 10.0::DOUBLE')} AS expected_supply_response_30m, {Q.r('greatest(predicted_shortage - estimated_shortage_reduction, 0.0::DOUBLE)')} AS expected_recovery_probability,
   {Q.r('estimated_shortage_reduction / greatest(estimated_action_cost, 0.1::DOUBLE)')} AS expected_roi, {_TRIGGERED} AS constraints_triggered FROM priced)"""
_TO_CARDS = (*_TO_OPTIONS, _BEST_SQL, _PRICED_SQL, _CARD_SQL)
_CARD_COLUMNS = ("recommendation_id", "zone_id", "zone_name", "region", "timestamp", "taxi_count", "risk_level", "delay_risk_score", "demand_pressure_score", "imbalance_score",
                 "predicted_shortage", "severity_bucket", "persistence_count", "neighbor_surplus", "recommended_action", "action_reason", "estimated_action_cost",
                 "estimated_shortage_reduction", "issue_detected", "recommendation", "expected_impact", "confidence", "priority", "explanation_tag", "root_cause",
                 "network_warning", "incentive_level", "expected_supply_response_30m", "expected_recovery_probability", "expected_roi", "constraints_triggered")


def card_rows(spark, folder):
    return C.cards(_decided(spark, folder), P.now())


@query("X-03 X-04 X-05 X-07 M-23 M-24 M-29", Q.with_(*_TO_CARDS) + f"SELECT {', '.join(_CARD_COLUMNS)} FROM card")
def recommendation_cards(spark, folder):
    return card_rows(spark, folder).select(*_CARD_COLUMNS)


@query("A-11 L-04", Q.with_(*_TO_CARDS) + f"""SELECT CAST(count(*) AS BIGINT) AS cards, {Q.count_if("priority = 'critical'")} AS critical, {Q.count_if("priority = 'high'")} AS high,
  {Q.count_if("priority = 'medium'")} AS medium, {Q.count_if("priority = 'low'")} AS low,
  CAST(round_even(CAST(sum(CAST(confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 100.0::DOUBLE, 0) AS INTEGER) AS avg_confidence_pct,
  CAST(round_even(min(confidence) * 100.0::DOUBLE, 0) AS INTEGER) AS min_confidence_pct, CAST(round_even(max(confidence) * 100.0::DOUBLE, 0) AS INTEGER) AS max_confidence_pct,
  {Q.r('CAST(sum(CAST(delay_risk_score AS DECIMAL(18,6))) AS DOUBLE) / count(*)')} AS avg_risk FROM card""")
def card_priority_counts(spark, folder):
    return C.card_summary(card_rows(spark, folder))


@query("P-09 L-04", Q.with_(*_TO_CARDS) + "SELECT recommendation_id, zone_id, priority, delay_risk_score FROM card WHERE priority = 'high'")
def cards_by_priority(spark, folder):
    return C.ranked_cards(card_rows(spark, folder), "HIGH").select("recommendation_id", "zone_id", "priority", "delay_risk_score")


@query("P-10 L-09", Q.with_(*_TO_CARDS) + """SELECT recommendation_id, zone_name, delay_risk_score, confidence FROM card
  WHERE (lower(zone_name) LIKE '%zone1%' OR lower(issue_detected) LIKE '%zone1%') AND delay_risk_score BETWEEN 0.3 AND 0.8""")
def card_search(spark, folder):
    return C.search_cards(card_rows(spark, folder), "zone1", 0.3, 0.8, "confidence_desc").select(
        "recommendation_id", "zone_name", "delay_risk_score", "confidence")


@query("N-07 M-27", Q.with_(*_TO_CARDS) + f"""SELECT recommendation_id, zone_id, recommended_action AS action_type, delay_risk_score AS score_at_time, CAST(taxi_count AS INTEGER) AS supply_at_time,
  'unknown' AS eta_bucket, false AS adjacent_risk_flag, {Q.NOW_SQL} + INTERVAL 30 MINUTE AS check_after,
  CASE WHEN CAST('0x' || left(sha1(CAST(zone_id AS VARCHAR) || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S')), 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.1::DOUBLE
    THEN 'holdout' ELSE 'treatment' END AS evaluation_bucket FROM card""")
def outcome_records_opened(spark, folder):
    return C.open_outcomes(card_rows(spark, folder), P.now()).select(
        "recommendation_id", "zone_id", "action_type", "score_at_time", "supply_at_time", "eta_bucket", "adjacent_risk_flag", "check_after", "evaluation_bucket")


def _says(*words):
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query("X-06", f"""SELECT doc_id, CASE WHEN {_says('ops team', 'ops alert')} THEN 'ops_alert' WHEN {_says('rebalance')} AND {_says('incentive', 'bonus')} THEN 'rebalance_plus_incentive'
  WHEN {_says('rebalance')} THEN 'rebalance' WHEN {_says('incentive', 'bonus')} THEN 'incentive' WHEN {_says('monitor')} THEN 'monitor' WHEN {_says('escalat')} THEN 'escalation'
  WHEN {_says('surge', 'fare', 'pricing')} AND {_says('push', 'notification', 'notify')} THEN 'surge_plus_push' WHEN {_says('surge', 'fare', 'pricing')} THEN 'surge_pricing'
  WHEN {_says('push', 'notification', 'notify')} THEN 'push_notification' WHEN lang = 'en' OR {_says('no action')} THEN 'none' ELSE 'monitor' END AS action_type
  FROM (SELECT doc_id, lang, lower(text) AS t FROM documents)""")
def action_from_text(spark, folder):
    d = table(use_utc(spark), folder, "documents")
    return d.select("doc_id", T.action_from_text(F.when(F.col("lang") == "en", "low").otherwise("high"), "text").alias("action_type"))


@query("X-15", """SELECT c_custkey, upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) AS map_key FROM customer""")
def map_key_names(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", T.map_key_name("c_mktsegment").alias("map_key"))


@query("M-27", """SELECT o_orderkey, CASE WHEN m IS NULL THEN 'unknown' WHEN m < 10 THEN 'under_10m' WHEN m < 20 THEN '10_to_20m' WHEN m < 45 THEN '20_to_45m' ELSE '45m_plus' END AS eta_bucket,
  CASE WHEN o_orderkey % 20 >= 12 THEN 'high' WHEN o_orderkey % 20 >= 6 THEN 'medium' ELSE 'low' END AS confidence_band
  FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 60 END AS m FROM orders)""")
def eta_and_confidence(spark, folder):
    from zonetide.functions import scoring as X

    o = table(spark, folder, "orders")
    eta = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 60)
    return o.select("o_orderkey", X.eta_bucket(eta).alias("eta_bucket"), X.confidence_band(F.col("o_orderkey") % 20).alias("confidence_band"))


