from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonetide.functions import clock, numeric, scoring, text
from zonetide.settings import DecisionSettings


@pytest.mark.parametrize("score,level", [(0.39, "low"), (0.40, "medium"), (0.69, "medium"), (0.70, "high")])
def test_risk_level(one, score, level):
    assert one(scoring.level("s"), s=score) == level


@pytest.mark.parametrize("shortage,bucket", [(0.2, "low"), (0.25, "low"), (0.4, "moderate"), (0.55, "moderate"), (0.7, "high"),
                                             (0.85, "severe"), (0.9, "severe"), (float("nan"), "low")])
def test_severity(one, shortage, bucket):
    assert one(scoring.severity("s", DecisionSettings()), s=shortage) == bucket


@pytest.mark.parametrize("risk,imbalance,supply,action", [(0.2, 0.2, 40, "no_action"), (0.5, 0.3, 20, "watchlist"), (0.2, 0.2, 14, "watchlist"),
                                                          (0.8, 0.7, 10, "intervention"), (0.1, 0.75, 90, "intervention")])
def test_policy(one, risk, imbalance, supply, action):
    assert one(scoring.policy_action("r", "i", "c"), r=risk, i=imbalance, c=supply) == action


def test_round_even_is_what_numpy_does(spark):
    values = np.random.default_rng(1).normal(size=2000).round(6).tolist() + [0.03125, 0.5, -0.00005, 1e-9]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", numeric.round_even("v").alias("r"))
    for row in df.collect():
        assert row["r"] == np.round(row["v"], 4)


@pytest.mark.parametrize("mm,level", [(0.0, 0), (0.1, 1), (2.0, 1), (2.01, 2), (10.0, 2), (10.5, 3)])
def test_rain_intensity(one, mm, level):
    assert one(scoring.rain_intensity("m"), m=mm) == level


def test_relative_drop_is_clipped_and_guarded(one):
    assert one(scoring.relative_drop("b", "n"), b=99.0, n=49.0) == pytest.approx(0.5)
    assert one(scoring.relative_drop("b", "n"), b=0.0, n=1000.0) == -2.0
    assert one(scoring.relative_level("n", "b"), n=100.0, b=0.0) == 5.0


def test_pressure_and_imbalance_bounds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 24)), bool(rng.integers(0, 2)), int(rng.integers(0, 4)), int(rng.integers(0, 2)), float(rng.uniform(0, 4)),
             float(rng.integers(0, 200)), float(rng.integers(0, 200))) for _ in range(500)]
    df = spark.createDataFrame(rows, "hour_of_day int, is_weekend boolean, rain_intensity int, train_disruption_flag int, congestion_ratio double, c double, b double")
    out = df.withColumn("p", scoring.demand_pressure()).withColumn("i", scoring.imbalance("p", "c", "b")).withColumn(
        "s", scoring.predicted_shortage("p", "c", "p", "b"))
    low = out.agg(*[F.min(x) for x in "pis"], *[F.max(x) for x in "pis"]).first()
    assert min(low[:3]) >= 0 and max(low[3:]) <= 1
    worse = [one for one in out.select("c", "b", "p", "i").limit(50).collect()]
    for r in worse:
        support = max(r["c"], 0) / max(r["b"] or r["c"], 1)
        ratio = min(max(r["p"] / max(support, 0.05) / 2.5, 0), 1)
        diff = min(max((r["p"] - min(max(support, 0), 1) + 1) / 2, 0), 1)
        assert r["i"] == pytest.approx(ratio * 0.6 + diff * 0.4, abs=6e-5)


def test_baseline_null_or_zero_means_current_supply(one):
    assert one(scoring.predicted_shortage("p", "c", "r", "b"), p=0.5, c=10.0, r=0.5, b=0.0) == pytest.approx(0.4)
    e = scoring.predicted_shortage("p", "c", "r", F.lit(None).cast("double"))
    assert one(e, p=0.5, c=10.0, r=0.5) == pytest.approx(0.4)


@pytest.mark.parametrize("h,want", [(0, 7), (7, 0), (8, 9), (17, 0), (18, 13), (23, 8)])
def test_hours_to_peak(one, h, want):
    assert one(clock.hours_to_peak("h"), h=h) == want


def test_calendar(one):
    assert one(clock.is_holiday(F.lit("2024-12-25"))) is True
    assert one(clock.is_holiday_eve(F.lit("2024-12-24"))) is True
    assert one(clock.is_school_holiday(F.lit("2024-06-23"))) is True
    assert one(clock.is_school_holiday(F.lit("2024-06-24"))) is False


def test_tolerant_parsing(one):
    assert one(clock.parse_iso("t"), t="not a time") is None
    assert one(clock.iso_text("t"), t="") == ""
    assert one(clock.iso_text("t"), t="2026-04-17T08:30:00Z").startswith("2026-04-17T08:30:00")
    assert one(clock.iso_text("t"), t="2026-04-17T08:30:00+08:00").startswith("2026-04-17T00:30:00")
    assert one(numeric.safe_int("t", -1), t="oops") == -1
    assert one(numeric.safe_int("t"), t="-3.9") == -3
    assert one(numeric.safe_double("t"), t="nan") == 0.0
    assert one(numeric.label_of("t"), t="  ") == "unknown"
    assert one(numeric.finite("v", 7.0), v=math.inf) == 7.0


def test_ids_match_sha1(one):
    assert one(text.recommendation_id("z", "t", "a"), z=7, t="2024-01-01", a="monitor") == hashlib.sha1(b"7|2024-01-01|monitor").hexdigest()[:16]


def test_holdout_bucket_is_stable_and_near_its_rate(spark):
    df = spark.range(20000).select(text.holdout_bucket("id", F.lit("2024-01-01")).alias("b"))
    share = df.filter("b = 'holdout'").count() / 20000
    assert 0.09 < share < 0.11
    want = int(hashlib.sha1(b"5|2024-01-01").hexdigest()[:8], 16) / 0xFFFFFFFF < 0.1
    got = spark.range(5, 6).select(text.holdout_bucket("id", F.lit("2024-01-01"))).first()[0]
    assert (got == "holdout") == want


@pytest.mark.parametrize("sentence,action", [
    ("Alert the ops team now", "ops_alert"), ("Rebalance with a bonus", "rebalance_plus_incentive"), ("Rebalance drivers", "rebalance"),
    ("Offer incentive", "incentive"), ("Keep monitoring", "monitor"), ("Escalate", "escalation"), ("Surge and notify", "surge_plus_push"),
    ("Raise fare", "surge_pricing"), ("Send push", "push_notification"), ("No action", "none"), ("Something else", "monitor")])
def test_action_from_text(one, sentence, action):
    assert one(text.action_from_text(F.lit("high"), "s"), s=sentence) == action


def test_priority_and_cause(one):
    assert one(text.priority("a", "r", "s"), a="ops_alert", r="low", s="low") == "critical"
    assert one(text.priority("a", "r", "s"), a="monitor", r="low", s="severe") == "high"
    assert one(text.priority("a", "r", "s"), a="monitor", r="medium", s="low") == "medium"
    assert one(text.root_cause("t", "p", "d"), t="rain + peak hour", p=0.9, d=0.9) == "weather"
    assert one(text.root_cause("t", "p", "d"), t="normal conditions", p=0.1, d=0.31) == "rapid_depletion"


def test_explanation_tag(spark):
    df = spark.createDataFrame([(5.0, 0.5, 0.3, 0.5, True, 0.0, True, True), (50.0, 0.0, 0.0, 1.0, False, 0.0, False, False)],
                               "taxi_count double, depletion_rate_1h double, depletion_rate_3h double, supply_vs_yesterday double, is_raining boolean, rainfall_mm double, is_peak_hour boolean, is_holiday boolean")
    tags = [r[0] for r in df.select(scoring.explanation_tag()).collect()]
    assert tags[0] == "rapid depletion + sustained depletion + critically low supply + below yesterday baseline + rain + peak hour + public holiday"
    assert tags[1] == "normal conditions"
    drivers = df.select(scoring.drivers_of(scoring.explanation_tag())).collect()
    assert len(drivers[0][0]) == 7 and drivers[1][0] == []


@pytest.mark.parametrize("before,after,outcome", [(0.8, 0.5, "recovered"), (0.8, 0.7, "improved"), (0.8, 0.8, "unchanged"), (0.8, 0.9, "worsened"), (0.0, 0.9, "unchanged")])
def test_outcome_class(one, before, after, outcome):
    assert one(scoring.outcome_class("b", "a"), b=before, a=after) == outcome


def test_report_notes(one):
    assert one(text.psi_impact("p", "q"), p=0.3, q=0.5).endswith("Current precision: 50.0%.")
    assert "stable" in one(text.psi_impact("p", F.lit(None)), p=0.05)
    assert "~5 may be" in one(text.false_positive_note("q"), q=0.5)
    now = F.lit("2024-03-01").cast("timestamp")
    old = one(text.model_advice("p", "f", F.lit("2024-01-01").cast("timestamp"), now), p=0.3, f=0.4)
    assert old.startswith("Recommended actions: retrain immediately; review") and "60 days old" in old
    assert one(text.model_advice("p", "f", F.lit(None).cast("timestamp"), now), p=0.0, f=0.9).startswith("Model is healthy")
    assert one(text.sample_size_note("n"), n=5).startswith("⚠ Only 5")
    assert one(text.map_key_name("z"), z="DOWNTOWN CORE") == "Downtown Core"
