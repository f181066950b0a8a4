from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from zonetide.operators import outcomes as O

KINDS = ("recommendation_id string, action_id string, action_type string, risk_level string, root_cause string, intervention_window string, adjacent_risk_flag boolean, "
         "outcome string, followed_status string, score_at_time double, score_after double, supply_delta_30m double, estimated_cost_sgd double")


def _log(spark, rows):
    base = dict(recommendation_id="r", action_id="x", action_type="rebalance", risk_level="high", root_cause="weather", intervention_window=None, adjacent_risk_flag=False,
                outcome=None, followed_status=None, score_at_time=0.8, score_after=None, supply_delta_30m=None, estimated_cost_sgd=None)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], KINDS)


def test_followed_outcomes_count_alone(spark):
    rows = [dict(outcome="recovered", followed_status="followed", score_after=0.4)] * 2 + [dict(outcome="worsened", followed_status="not_followed", score_after=0.9)] * 3 + [{}]
    e = O.effectiveness(_log(spark, rows)).first()
    assert (e["total"], e["resolved"], e["followed_resolved"], e["unfollowed_resolved"]) == (6, 5, 2, 3)
    assert (e["follow_rate"], e["recovery_rate"], e["improvement_rate"], e["estimated_score_delta"]) == (0.4, 0.75, 0.75, -0.4)
    assert e["expected_roi"] == pytest.approx(0.75 * 2 + 0.75 + 0.4 * 5) and e["confidence_band"] == "low"


def test_without_followed_all_resolved_count(spark):
    rows = [dict(outcome="improved", score_after=0.6, supply_delta_30m=4.0, estimated_cost_sgd=2.0)] * 12
    e = O.effectiveness(_log(spark, rows)).first()
    assert e["confidence_band"] == "high" and e["expected_supply_response_30m"] == 4.0 and e["avg_estimated_cost_sgd"] == 2.0
    assert e["expected_roi"] == pytest.approx((1 / 14 * 2 + 13 / 14 + 0.4 + 1.0) / 2, abs=1e-4)
    nothing = O.effectiveness(_log(spark, [{}])).first()
    assert nothing["recovery_rate"] == 0.0 and nothing["expected_roi"] == 0.0


def test_ladder_falls_back_to_broader_contexts(spark):
    rows = ([dict(action_id="x", outcome="recovered")] * 2 + [dict(action_id="y", outcome="recovered", root_cause="peak")] * 2 + [dict(action_id="z", action_type="monitor")])
    log = _log(spark, rows)
    wanted = _log(spark, [dict(action_id="x"), dict(action_id="z", action_type="monitor"), dict(action_id="new", action_type="unseen")])
    out = {r["action_id"]: r for r in O.context_effectiveness(log, wanted).collect()}
    assert out["x"]["policy_rank_reason"] == "Based on same action and risk level; 4 resolved examples, low confidence."
    assert out["z"]["policy_rank_reason"].startswith("Based on exact action variant and context; 0 resolved")
    assert out["new"]["policy_rank_reason"].startswith("No resolved outcomes") and out["new"]["total"] == 0


def test_null_keys_match_null_keys_only(spark):
    log = _log(spark, [dict(intervention_window=None, outcome="recovered")] * 3 + [dict(intervention_window="peak", outcome="worsened")] * 3)
    out = O.context_effectiveness(log, _log(spark, [{}])).first()
    assert out["total"] == 3 and out["policy_rank_reason"].startswith("Based on exact action variant and context")


def test_resolution_waits_and_leaves_unknown_zones_open(spark):
    issued = spark.createDataFrame([("a", 1, 0.8, 10, "2024-01-01 00:30:00"), ("b", 1, 0.8, 10, "2024-01-01 02:00:00"), ("c", 9, 0.8, 10, "2024-01-01 00:30:00")],
                                   "recommendation_id string, zone_id long, score_at_time double, supply_at_time int, t string").withColumn("check_after", F.col("t").cast("timestamp")).drop("t")
    current = spark.createDataFrame([(1, 0.9, 3, "2024-01-01 00:00:00"), (1, 0.4, 17, "2024-01-01 01:00:00")],
                                    "zone_id long, delay_risk_score double, taxi_count int, t string").withColumn("timestamp", F.col("t").cast("timestamp"))
    done = O.resolve(issued, current, F.lit("2024-01-01 01:00:00").cast("timestamp"))
    rows = done.collect()
    assert [(r["recommendation_id"], r["outcome"], r["score_after"], r["supply_delta_30m"]) for r in rows] == [("a", "recovered", 0.4, 7)]
    assert {r["recommendation_id"] for r in O.unresolved(issued, done).collect()} == {"b", "c"}


def test_feedback_newest_valid_wins(spark):
    fb = spark.createDataFrame([("a", "Followed ", "2024-01-01"), ("a", "not_followed", "2024-01-02"), ("a", "maybe", "2024-01-03")],
                               "recommendation_id string, followed_status string, t string").select(
        "recommendation_id", "followed_status", F.col("t").cast("timestamp").alias("followed_at"), F.lit(None).cast("string").alias("followed_by"), F.lit(None).cast("string").alias("follow_note"))
    recs = spark.createDataFrame([("a",), ("a",), ("b",)], "recommendation_id string")
    got = sorted((r["recommendation_id"], r["followed_status"]) for r in O.with_feedback(recs, fb).collect() if r["followed_status"])
    assert got == [("a", "not_followed"), ("a", "not_followed")]


def test_treatment_gap_and_missing_bucket(spark):
    df = spark.createDataFrame([("treatment", "recovered"), (None, "worsened"), ("holdout", "recovered"), ("holdout", None)], "evaluation_bucket string, outcome string")
    g = O.treatment_gap(df).first()
    assert (g["treatment_count"], g["holdout_count"], g["treatment_recovery_rate"], g["holdout_recovery_rate"], g["recovery_rate_gap"]) == (2, 2, 0.5, 0.5, 0.0)
    assert O.treatment_gap(df.limit(0)).first()["treatment_count"] == 0
