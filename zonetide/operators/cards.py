"""Recommendation cards and the outcome records opened for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions import scoring as X
from zonetide.functions import text as T
from zonetide.functions.numeric import clip, count_where, round_even
from zonetide.operators.enrich import with_defaults

INCENTIVES = ("incentive", "rebalance_plus_incentive")
MOVES = ("rebalance", "rebalance_plus_incentive")
CARD_DEFAULTS = {
    "severity_bucket": "low", "recommended_action": "monitor", "predicted_shortage": 0.0,
    "estimated_shortage_reduction": 0.0, "estimated_action_cost": 0.0, "neighbor_surplus": 0.0,
    "budget_remaining": 0.0, "persistence_count": 0, "demand_pressure_score": 0.0, "imbalance_score": 0.0,
    "imbalance_level": "low", "policy_action": "no_action", "policy_reason": "", "action_reason": "",
    "explanation_tag": "", "constraints_triggered": "[]", "depletion_rate_1h": 0.0, "region": "",
}


def timestamp_text(ts: str = "timestamp") -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def cards(decisions: DataFrame, now: Column, ts_text: Column | None = None) -> DataFrame:
    """One card per decided zone: a projection, no shuffle."""
    df = with_defaults(decisions, CARD_DEFAULTS)
    action, zone, bucket = F.col("recommended_action"), F.col("zone_name"), F.col("severity_bucket")
    score = F.coalesce(F.col("delay_risk_score"), F.lit(0.0))
    shortage, gain, cost = F.col("predicted_shortage"), F.col("estimated_shortage_reduction"), F.col("estimated_action_cost")
    stamp = timestamp_text() if ts_text is None else ts_text
    risk = F.col("risk_level") if "risk_level" in df.columns else X.level(score)
    urgency = T.priority(action, risk, bucket)
    todo, effect = T.action_text(action, zone)
    none = lambda kind: F.lit(None).cast(kind)
    # The wording inside the cards.
    return df.select(
        T.recommendation_id("zone_id", stamp, action).alias("recommendation_id"),
        "zone_id", "zone_name", "region", "timestamp", "taxi_count",
        risk.alias("risk_level"), round_even(score).alias("delay_risk_score"),
        round_even(F.coalesce(F.col("depletion_risk_score"), score)).alias("depletion_risk_score"),
        round_even("demand_pressure_score").alias("demand_pressure_score"),
        round_even("imbalance_score").alias("imbalance_score"), "imbalance_level", "policy_action", "policy_reason",
        round_even(shortage).alias("predicted_shortage"), "severity_bucket", "persistence_count",
        round_even("neighbor_surplus").alias("neighbor_surplus"), "recommended_action", "action_reason",
        round_even(cost).alias("estimated_action_cost"), round_even(gain).alias("estimated_shortage_reduction"),
        round_even("budget_remaining").alias("budget_remaining"),
        F.format_string("%s shortage stress in %s (score %.3f).", F.initcap(bucket), zone,
                        round_even(shortage, 3)).alias("issue_detected"),
        todo.alias("recommendation"), effect.alias("expected_impact"),
        round_even(clip(score * F.lit(0.85) + shortage * F.lit(0.15), 0.25, 0.99), 2).alias("confidence"),
        urgency.alias("priority"), "explanation_tag", now.alias("last_updated"),
        none("int").alias("eta_minutes"), none("string").alias("intervention_window"),
        F.lit("").alias("adjacent_risk_zones"),
        F.when(action.isin(*MOVES), "Rebalance depends on adjacent exportable surplus.").otherwise("").alias("network_warning"),
        T.root_cause("explanation_tag", "demand_pressure_score", "depletion_rate_1h").alias("root_cause"),
        action.alias("action_id"), action.alias("action_type"), F.lit("none").alias("pricing_level"),
        F.when(action.isin(*INCENTIVES), "targeted").otherwise("none").alias("incentive_level"),
        F.lit("none").alias("push_level"),
        none("double").alias("expected_recovery_rate"), none("double").alias("expected_improvement_rate"),
        round_even(-gain).alias("estimated_score_delta"),
        F.when(urgency.isin("critical", "high"), "medium").otherwise("low").alias("confidence_band"),
        F.lit(0).alias("evidence_count"), none("double").alias("follow_rate"),
        F.when(F.col("action_reason") != "", F.col("action_reason")).otherwise(
            "Deterministic intervention selection from predicted shortage and constraints.").alias("policy_rank_reason"),
        round_even(cost).alias("estimated_cost_sgd"),
        round_even(gain * F.lit(10.0)).alias("expected_supply_response_30m"),
        round_even(F.greatest(shortage - gain, F.lit(0.0))).alias("expected_recovery_probability"),
        round_even(gain / F.greatest(cost, F.lit(0.1))).alias("expected_roi"),
        F.lit("reliability_first").alias("decision_objective"), F.col("action_reason").alias("winning_reason"),
        "constraints_triggered", F.lit("[]").alias("alternative_actions"))


def priority_rank(column: str = "priority") -> Column:
    """Sort key of a priority; unknown ones come last."""
    out = None
    for name, rank in S.PRIORITY_ORDER.items():
        out = F.when(F.col(column) == name, rank) if out is None else out.when(F.col(column) == name, rank)
    return out.otherwise(99)


def card_order() -> list[Column]:
    return [priority_rank().asc(), F.col("delay_risk_score").desc(), F.col("zone_id").asc()]


def ranked_cards(df: DataFrame, priority: str | None = None) -> DataFrame:
    kept = df if priority is None else df.filter(F.col("priority") == priority.lower())
    return kept.orderBy(*card_order())


CARD_SORTS = {
    "risk_desc": [("delay_risk_score", False)],
    "risk_asc": [("delay_risk_score", True)],
    "zone_asc": [("zone_name", True)],
    "confidence_desc": [("confidence", False)],
}


def search_cards(df: DataFrame, text: str = "", low: float = 0.0, high: float = 1.0,
                 sort: str = "risk_desc") -> DataFrame:
    """Cards whose zone or issue contains the text, within a score range, in the chosen order."""
    hit = F.lower("zone_name").contains(text.lower()) | F.lower("issue_detected").contains(text.lower())
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in CARD_SORTS[sort]]
    return df.filter(hit & F.col("delay_risk_score").between(low, high)).orderBy(*keys, F.col("zone_id").asc())


def card_summary(df: DataFrame) -> DataFrame:
    """Cards per priority, confidence range in percent and mean risk, one row."""
    percent = lambda c: F.rint(c * F.lit(100.0)).cast("int")
    exact = F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count("confidence")
    risk = F.sum(F.col("delay_risk_score").cast("decimal(18,6)")).cast("double") / F.count("delay_risk_score")
    return df.agg(
        F.count(F.lit(1)).alias("cards"),
        *[count_where(F.col("priority") == p).alias(p) for p in S.PRIORITY_ORDER],
        percent(exact).alias("avg_confidence_pct"), percent(F.min("confidence")).alias("min_confidence_pct"),
        percent(F.max("confidence")).alias("max_confidence_pct"), round_even(risk).alias("avg_risk"))


def open_outcomes(df: DataFrame, now: Column, ts_text: Column | None = None,
                  minutes: int = S.OUTCOME_WINDOW_MINUTES, holdout_rate: float = 0.1) -> DataFrame:
    """Outcome records for new cards: what was known, when to check, which bucket. Append-only."""
    base = with_defaults(df, {"taxi_count": 0}, fill=False)
    stamp = timestamp_text() if ts_text is None else ts_text
    given = F.coalesce(F.nullif(F.trim("action_type"), F.lit("")),
                       F.nullif(F.trim("recommended_action"), F.lit("")),
                       T.action_from_text("priority", "recommendation"))
    kept = ["recommendation_id", "action_id", "zone_id", "zone_name", "pricing_level", "incentive_level", "push_level",
            "priority", "depletion_risk_score", "demand_pressure_score", "imbalance_score", "imbalance_level",
            "risk_level", "root_cause", "policy_action", "policy_reason", "alternative_actions", "estimated_cost_sgd",
            "expected_supply_response_30m", "expected_recovery_probability", "expected_recovery_rate",
            "expected_improvement_rate", "estimated_score_delta", "expected_roi", "decision_objective",
            "winning_reason", "constraints_triggered", "confidence_band", "evidence_count", "follow_rate",
            "policy_rank_reason"]
    return base.select(
        *kept, given.alias("action_type"), round_even("delay_risk_score").alias("score_at_time"),
        F.coalesce(F.col("taxi_count").cast("int"), F.lit(0)).alias("supply_at_time"),
        F.coalesce(F.col("intervention_window"), F.lit("unknown")).alias("intervention_window"),
        X.eta_bucket("eta_minutes").alias("eta_bucket"),
        (F.trim(F.coalesce("adjacent_risk_zones", F.lit(""))) != "").alias("adjacent_risk_flag"),
        now.alias("logged_at"), (now + F.make_interval(mins=F.lit(minutes))).alias("check_after"),
        T.holdout_bucket("zone_id", stamp, holdout_rate).alias("evaluation_bucket"))
