from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonetide.operators import drift as DR
from zonetide.operators import metrics as M
from zonetide.operators import reports as RP
from zonetide.operators import scoring as SC
from zonetide.operators import versions as V


def _tall(spark, values):
    return spark.createDataFrame([("f", float(v)) for v in values], "feature string, value double")


def _psi(e, a):
    lo, hi = min(e.min(), a.min()), max(e.max(), a.max())
    edges = np.linspace(lo, hi, 11)
    p, q = (np.histogram(x, bins=edges)[0] / len(x) for x in (e, a))
    p, q = p.clip(1e-6), q.clip(1e-6)
    return float(max(np.sum((q - p) * np.log(q / p)), 0))


@pytest.mark.parametrize("seed", [1, 2])
def test_psi_equals_histograms(spark, seed):
    rng = np.random.default_rng(seed)
    e, a = rng.beta(2, 5, 800).round(3), rng.beta(2, 3, 500).round(3)
    got = DR.psi(_tall(spark, e), _tall(spark, a)).first()
    assert got["psi"] == pytest.approx(_psi(e, a), rel=1e-9) and (got["n_ref"], got["n_cur"]) == (800, 500)


def test_psi_of_equal_and_constant_samples_is_zero(spark):
    same = _tall(spark, [0.1, 0.2, 0.9])
    assert DR.psi(same, same).first()["psi"] == 0.0
    flat = _tall(spark, [0.5, 0.5])
    assert DR.psi(flat, flat).first()["psi"] == 0.0


def test_psi_of_stored_counts_equals_psi_of_rows(spark):
    rng = np.random.default_rng(6)
    ref, cur = (spark.createDataFrame([(float(x),) for x in rng.beta(2, b, 3000).round(3)], "taxi_count double") for b in (5, 4))
    counts = [DR.feature_counts(d, ["taxi_count"]) for d in (ref, cur)]
    assert counts[0].count() < 1000
    a, b = DR.psi(*counts).first(), DR.psi(*[DR.stacked(d, ["taxi_count"]) for d in (ref, cur)]).first()
    assert a["psi"] == pytest.approx(b["psi"], rel=1e-9) and a["n_ref"] == b["n_ref"] == 3000


def test_drift_alert_names_features(spark):
    rng = np.random.default_rng(0)
    ref = spark.createDataFrame([(float(x), float(y)) for x, y in zip(rng.uniform(0, 0.4, 300), rng.uniform(0, 1, 300))], "delay_risk_score double, taxi_count double")
    cur = spark.createDataFrame([(float(x), float(y) + 5) for x, y in zip(rng.uniform(0.5, 1, 300), rng.uniform(0, 1, 300))], "delay_risk_score double, taxi_count double")
    rows = DR.drift_alerts(DR.score_drift(ref, cur), DR.feature_drift(ref, cur), F.current_timestamp()).collect()
    assert rows[0]["alert_id"] == "DRIFT_ALERT" and rows[0]["severity"] == "high" and rows[0]["message"].endswith("(features: taxi_count)")
    assert DR.drift_alerts(DR.score_drift(ref, ref), None, F.current_timestamp()).count() == 0


@pytest.mark.parametrize("scored,failed,psi,flag,want", [(1000, 300, 0.0, False, True), (1000, 200, 0.0, False, False), (0, 50, 0.0, False, False),
                                                         (1000, 0, 0.3, False, True), (1000, 0, 0.25, False, False), (1000, 0, 0.0, True, True)])
def test_rollback_rule(spark, scored, failed, psi, flag, want):
    run = spark.createDataFrame([(scored, failed, psi, flag)], "rows_scored long, failed_rows long, psi double, drift_flag boolean")
    out = DR.rollback_rule(run).first()
    assert out["should_rollback"] is want and bool(out["rollback_reason"]) is want
    if failed == 300:
        assert out["rollback_reason"] == "failed row pct 23.1% > 20%"


def _auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


def test_ranking_quality_by_brute_force(spark):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 400), rng.integers(0, 60, 400) / 60
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    got = M.evaluate(df).first()
    assert got["roc_auc"] == pytest.approx(_auc(y, p), abs=1e-4)
    f1 = {t: 2 * ((p >= t) & (y == 1)).sum() / ((p >= t).sum() + (y == 1).sum()) for t in np.unique(p)}
    top = max(f1.values())
    assert got["f1"] == pytest.approx(top, abs=1e-4) and got["best_threshold"] == pytest.approx(min(t for t, v in f1.items() if v > top - 1e-12), abs=1e-4)
    assert got["tp"] + got["fp"] + got["fn"] + got["tn"] == 400 and got["n_test"] == 400
    sweep = {r["threshold"]: r for r in M.threshold_sweep(df).collect()}
    assert sweep[0.5]["missed"] == ((p < 0.5) & (y == 1)).sum() and len(sweep) == 13


def test_calibration_bins_are_right_closed(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.0), (1, 0.11), (1, 1.0)], "y int, p double")
    assert {r["bin"]: r["n"] for r in M.calibration(df).collect()} == {1: 2, 2: 1, 10: 1}


def test_zone_performance_and_window(spark):
    now = F.lit("2024-01-15").cast("timestamp")
    rows = [(1, "2024-01-09", 0.9), (1, "2024-01-14", 0.2), (2, "2024-01-14", 0.75), (3, "2023-12-01", 0.9)]
    hist = spark.createDataFrame(rows, "zone_id long, t string, score double").select("zone_id", F.col("t").cast("timestamp").alias("timestamp"), "score")
    out = {r["zone_id"]: r for r in RP.zone_performance(hist, now, 7).collect()}
    assert out[1]["trend"] == "improving" and out[1]["trend_delta"] == -0.7 and out[2]["trend"] == "stable" and 3 not in out
    lists = RP.performance_lists(RP.zone_performance(hist, now, 7)).collect()
    assert [r["zone_id"] for r in lists if r["list_name"] == "chronic_high_risk"] == [2, 1]
    assert RP.window_days(30) == (30, None) and "only the most recent 14 days" in RP.window_days(30, 14)[1] and RP.window_days(0) == (1, None)


def test_trend_fallbacks(spark):
    runs = spark.createDataFrame([("2024-01-01 00:00:00", None, 5), ("2024-01-01 10:00:00", None, 6)], "timestamp string, supply_now int, total_taxi_count int")
    assert [r["value"] for r in RP.trend(runs, "supply_now", "total_taxi_count").orderBy("timestamp").collect()] == [5, 6]
    pts = RP.trend(runs, "total_taxi_count")
    assert RP.recent_points(pts, 6).count() == 1
    broken = pts.withColumn("timestamp", F.lit("n/a"))
    assert RP.recent_points(broken, 6).count() == 2


def test_alert_dedup_and_age(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    log = spark.createDataFrame([("A", "old", "2023-12-30"), ("B", "first", "2024-01-01 01:00:00"), ("B", "second", "2024-01-01 02:00:00")],
                                "alert_id string, message string, t string").withColumn("created_at", F.col("t").cast("timestamp")).drop("t")
    out = RP.all_alerts(log, log.limit(0), now).collect()
    assert [(r["alert_id"], r["message"]) for r in out] == [("B", "second")]


def test_defaults_for_empty_logs(spark):
    empty = spark.createDataFrame([], "run_id string, timestamp timestamp, rows_scored long")
    row = RP.latest_or_default(empty, {"rows_scored": 0}).first()
    assert row["run_id"] is None and row["rows_scored"] == 0
    seen = spark.createDataFrame([("a", None)], "service string, last_updated timestamp")
    assert RP.freshness(seen, F.current_timestamp()).first()["status"] == "down"


def test_history_keeps_last_row_per_zone(spark):
    df = spark.createDataFrame([(1, 0, 0.1, 5), (1, 1, 0.2, 6), (2, 0, 0.3, 7)], "zone_id long, n int, delay_risk_score double, taxi_count int")
    long = SC.history_rows(df, F.lit("2024-01-01").cast("timestamp"), order=("n",))
    maps = SC.history_maps(long).first()
    assert maps["zones"] == {"1": 0.2, "2": 0.3} and maps["taxi_counts"] == {"1": 6, "2": 7}
    assert SC.zone_history(SC.history_maps(long), 2).first()["value"] == 0.3 and SC.zone_history(SC.history_maps(long), 9).count() == 0


def _events(spark, *extra):
    base = [("v1", "candidate", "2024-01-01", 0, 0.9), ("v2", "candidate", "2024-02-01", 0, 0.8), ("v3", "candidate", "2024-03-01", 0, 0.7), ("v4", "candidate", "2024-04-01", 0, 0.0),
            ("v5", "candidate", "2024-05-01", 0, 0.6)]
    df = spark.createDataFrame(base, "version_id string, status string, d string, seq int, m double")
    first = df.select("version_id", "status", F.col("d").cast("timestamp").alias("at"), "seq", F.col("d").cast("timestamp").alias("trained_at"),
                      F.lit(None).cast("timestamp").alias("promoted_at"), *[F.col("m").alias(c) for c in V.METRICS])
    for e in extra:
        first = first.unionByName(e)
    return first


def test_version_transitions(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    ev = _events(spark)
    for i, v in enumerate(("v1", "v2", "v3")):
        ev = ev.unionByName(V.promote_events(V.current_versions(ev), v, at(f"2024-06-0{i + 1}")))
    now = V.current_versions(ev)
    assert {r["version_id"]: r["status"] for r in now.collect()} == {"v1": "previous", "v2": "previous", "v3": "active", "v4": "candidate", "v5": "candidate"}
    assert V.rollback_target(now).first()["version_id"] == "v2"
    shown = [r["version_id"] for r in V.lineage(now).collect()]
    assert "v4" not in shown and shown[0] == "v3" and {r["version_id"] for r in V.prunable(now).collect()} == {"v4"}
    back = V.current_versions(ev.unionByName(V.rollback_events(now, at("2024-06-09"))))
    assert {r["version_id"]: r["status"] for r in back.collect()} == {"v1": "previous", "v2": "active", "v3": "rolled_back", "v4": "candidate", "v5": "candidate"}
    assert V.promote_events(now, "nope", at("2024-07-01")).count() == 0
    assert V.rollback_events(V.current_versions(_events(spark)), at("2024-07-01")).count() == 0


def test_gate(spark):
    good = spark.createDataFrame([("c", 0.6, 0.6, 0.6, 0.8)], "version_id string, precision double, recall double, f1 double, roc_auc double")
    weak = spark.createDataFrame([("c", 0.5, 0.5, 0.4, 0.6)], "version_id string, precision double, recall double, f1 double, roc_auc double")
    none = spark.createDataFrame([], "feature string")
    calm = spark.createDataFrame([(0.2, 0.2, 0.0, 1.0, 10, 10)], "candidate_std double, active_std double, lowest double, highest double, n_scored long, n_rows long")
    wild = spark.createDataFrame([(0.9, 0.2, 0.0, 1.2, 10, 10)], "candidate_std double, active_std double, lowest double, highest double, n_scored long, n_rows long")
    ok = V.gate(good, good, none, calm).first()
    assert ok["passed"] and ok["reason"] == "all checks passed"
    bad = V.gate(weak, good, spark.createDataFrame([("lag",)], "feature string"), wild).first()
    assert not bad["passed"] and not any(bad[c] for c in ("performance_ok", "regression_ok", "schema_ok", "integration_ok", "stability_ok"))
    assert bad["reason"].startswith("performance below threshold (F1=0.400 min=0.5, AUC=0.600 min=0.65)")
    assert V.gate(good, good.limit(0), none, calm).first()["passed"]


def test_psi_deals_no_values_out_by_feature(spark):
    """Every value of a feature in one task would be too much: the range of each feature goes to the values."""
    ref, cur = (spark.range(200).select(F.lit("a").alias("feature"), (F.col("id") % n).cast("double").alias("value")) for n in (17, 23))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = DR.psi(ref, cur)
        assert df.first()["psi"] > 0
        joins = [line for line in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "HashJoin" in line or "MergeJoin" in line]
        assert any("BroadcastHashJoin" in line for line in joins)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
