"""Identifiers, card wording and report notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonetide.functions.numeric import col_of
from zonetide.functions.scoring import psi_level


def _hashed(*parts) -> Column:
    return F.sha1(F.concat_ws("|", *[col_of(p).cast("string") for p in parts]))


def recommendation_id(zone_id, timestamp_text, action) -> Column:
    """Stable 16-digit id of a card."""
    return F.substring(_hashed(zone_id, timestamp_text, action), 1, 16)


def holdout_bucket(zone_id, timestamp_text, rate: float = 0.1) -> Column:
    """Stable treatment / holdout assignment from the first 32 bits of a hash."""
    head = F.conv(F.substring(_hashed(zone_id, timestamp_text), 1, 8), 16, 10).cast("double")
    return F.when(head / F.lit(4294967295.0) < rate, "holdout").otherwise("treatment")


def priority(action, risk, severity) -> Column:
    a, r, s = col_of(action), col_of(risk), col_of(severity)
    return (F.when(a == "ops_alert", "critical").when(s.isin("severe", "high") | (r == "high"), "high")
            .when((s == "moderate") | (r == "medium"), "medium").otherwise("low"))


def root_cause(tag, pressure, depletion) -> Column:
    """The leading cause: tag wording first, then signals."""
    t = F.lower(F.coalesce(col_of(tag), F.lit("")))
    p = F.coalesce(col_of(pressure).cast("double"), F.lit(0.0))
    d = F.coalesce(col_of(depletion).cast("double"), F.lit(0.0))
    # Key words, bands and causes.
    return (F.when(t.contains("rain"), "weather").when(t.contains("peak"), "peak_pattern")
            .when(p >= 0.7, "demand_pressure").when(d > 0.3, "rapid_depletion").otherwise("structural_gap"))


# Card sentences per action, "%s" is the zone name.
ACTION_TEXT = {
    "rebalance": (
        "Rebalance nearby driver supply into %s. Pull only from adjacent zones with safe exportable surplus.",
        "Near-term supply repositioning using adjacent-zone slack.",
    ),
    "incentive": (
        "Offer a targeted driver incentive for pickups in %s.",
        "Activate additional supply without physically draining adjacent zones.",
    ),
    "rebalance_plus_incentive": (
        "Rebalance nearby drivers into %s and pair it with a targeted incentive.",
        "Use both repositioning and spend to relieve sustained local stress.",
    ),
    "ops_alert": (
        "Escalate %s to the ops team for manual intervention.",
        "Automated levers are infeasible or insufficient for the current severity.",
    ),
}
MONITOR_TEXT = (
    "Continue monitoring %s; no active intervention is warranted yet.",
    "Maintain watchlist posture while preserving budget and adjacent supply.",
)


def action_text(action, zone_name) -> tuple[Column, Column]:
    """(what to do, what it should achieve) for an action in a zone."""
    a, z = col_of(action), col_of(zone_name)
    do, why = None, None
    for name, (sentence, effect) in ACTION_TEXT.items():
        filled = F.format_string(sentence, z)
        do = F.when(a == name, filled) if do is None else do.when(a == name, filled)
        why = F.when(a == name, effect) if why is None else why.when(a == name, effect)
    return do.otherwise(F.format_string(MONITOR_TEXT[0], z)), why.otherwise(MONITOR_TEXT[1])


def action_from_text(priority_label, recommendation) -> Column:
    """Canonical action type of a free-text recommendation. The first matching rule wins."""
    t = F.lower(F.coalesce(col_of(recommendation).cast("string"), F.lit("")))

    def says(*words: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        return hit

    # Key words and action names.
    move, pay = says("rebalance"), says("incentive", "bonus")
    price, push = says("surge", "fare", "pricing"), says("push", "notification", "notify")
    return (F.when(says("ops team", "ops alert"), "ops_alert")
            .when(move & pay, "rebalance_plus_incentive").when(move, "rebalance").when(pay, "incentive")
            .when(says("monitor"), "monitor").when(says("escalat"), "escalation")
            .when(price & push, "surge_plus_push").when(price, "surge_pricing")
            .when(push, "push_notification")
            .when((col_of(priority_label) == "low") | says("no action"), "none").otherwise("monitor"))


def _percent(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", value * F.lit(100.0))


def psi_impact(psi, precision) -> Column:
    """What a drift value means for operators."""
    p, q = col_of(psi).cast("double"), col_of(precision).cast("double")
    head = F.format_string("PSI=%.3f", p)
    grade = psi_level(p)
    # Report sentences.
    body = (F.when(grade == "significant",
                   " indicates significant data drift — the live distribution differs materially from "
                   "training data. Model predictions are less reliable; expect more false positives and "
                   "missed depletion-risk alerts.")
            .when(grade == "moderate",
                  " indicates moderate drift — early warning signal. Model performance may be degrading; "
                  "monitor closely and consider retraining soon.")
            .otherwise(" — distribution is stable. Model is operating within expected parameters."))
    tail = F.when(q.isNotNull(), F.concat(F.lit(" Current precision: "), _percent(q), F.lit("."))).otherwise("")
    return F.concat(head, body, tail)


def false_positive_note(precision) -> Column:
    q = col_of(precision).cast("double")
    miss = F.lit(1.0) - q
    # Report sentences.
    return F.when(q.isNull(), "Precision not available — retrain model to get updated metrics.").otherwise(
        F.concat(
            F.lit("At precision="), _percent(q), F.lit(", roughly "), _percent(miss, 0),
            F.lit(" of high-risk alerts are false positives. For every 10 interventions dispatched to "
                  "high-risk zones, ~"), F.rint(miss * F.lit(10.0)).cast("long").cast("string"),
            F.lit(" may be unnecessary. Retraining on more recent data can reduce this.")))


def model_advice(psi, f1, trained_at, now) -> Column:
    """Recommended next steps for the active model."""
    p, f = col_of(psi).cast("double"), col_of(f1).cast("double")
    age = F.floor(F.timestamp_diff("SECOND", col_of(trained_at), col_of(now)) / F.lit(86400)).cast("long")
    # Report sentences.
    todo = F.concat_ws(
        "; ",
        F.when(p >= 0.25, "retrain immediately").when(p >= 0.10, "schedule retraining within the week"),
        F.when(f < 0.50, "review feature engineering — F1 below 0.50 suggests structural issues"),
        F.when(age > 30, F.concat(F.lit("model is "), age.cast("string"),
                                  F.lit(" days old — refresh with recent data"))))
    return F.when(todo == "", "Model is healthy. Continue regular monitoring.").otherwise(
        F.concat(F.lit("Recommended actions: "), todo, F.lit(".")))


def sample_size_note(resolved) -> Column:
    n = col_of(resolved)
    count = n.cast("string")
    # Report sentences.
    return (F.when(n == 0,
                   "No resolved outcomes yet. The system logs recommendations and checks 30 min later. "
                   "Run the scoring pipeline across multiple cycles to accumulate data.")
            .when(n < 10, F.concat(F.lit("⚠ Only "), count, F.lit(
                " resolved outcome(s). Rates are not statistically meaningful at this sample size. "
                "Accumulate at least 30+ resolved outcomes before drawing conclusions.")))
            .when(n < 50, F.concat(F.lit("Note: "), count,
                                   F.lit(" resolved outcomes — directional signal only.")))
            .otherwise(""))


def map_key_name(zone_name) -> Column:
    """Zone name in title case, the key used by map layers."""
    return F.initcap(F.lower(col_of(zone_name)))
