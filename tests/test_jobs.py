from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from zonetide.learning import models as ML
from zonetide.operators.scoring import RISK
from zonetide.plans import jobs


def _snapshots(spark):
    rng = np.random.default_rng(8)
    kinds = ["CBD", "mixed", "industrial"]
    rows = [(z, f"Zone{z}", "Central", kinds[z % 3], int(30 + 25 * np.sin(h / 4) + rng.integers(0, 20)), h) for z in range(1, 5) for h in range(24 * 9)]
    return spark.createDataFrame(rows, "zone_id int, zone_name string, region string, zone_type string, taxi_count int, h int").withColumn(
        "timestamp", F.lit("2024-03-01").cast("timestamp") + F.make_interval(hours=F.col("h"))).drop("h")


def test_train_score_store_and_monitor(spark, tmp_path):
    hours = jobs.zone_hours(_snapshots(spark), congestion=spark.createDataFrame([(1, 1.4)], "zone_id int, congestion_ratio double"))
    assert hours.filter("zone_id = 1 and congestion_ratio = 1.4").count() == 24 * 9 and hours.filter("zone_id = 2 and congestion_ratio = 1.0").count() == 24 * 9
    model, wanted, metrics = jobs.train_run(hours, ML.decision_tree(depth=4))
    assert len(wanted) == 36 and 0 <= metrics.first()["roc_auc"] <= 1
    bad = hours.limit(1).withColumn("taxi_count", F.lit(9999))
    edges = spark.createDataFrame([(f"Zone{a}", f"Zone{a % 4 + 1}") for a in range(1, 5)], "zone string, neighbor string")
    now = F.lit("2024-03-10").cast("timestamp")
    out = jobs.score_run(hours.unionByName(bad), edges, now, model=model)
    assert out.failed.count() == 1 and out.predictions.count() == 4 * 24 * 9 and out.decisions.count() == 4
    r = out.predictions.agg(F.min(RISK), F.max(RISK)).first()
    assert 0 <= r[0] <= r[1] <= 1
    jobs.store_run(out, str(tmp_path), "r1")
    jobs.store_run(out, str(tmp_path), "r1")  # a retried run replaces its own rows
    assert spark.read.parquet(str(tmp_path / "predictions")).count() == 4 * 24 * 9 and spark.read.parquet(str(tmp_path / "issued")).count() == 4
    runs = spark.read.json(str(tmp_path / "runs")).withColumn("failed_rows", F.lit(1))
    shifted = out.predictions.withColumn(RISK, F.lit(1.0) - F.col(RISK))
    seen = jobs.monitor_run(out.predictions, shifted, runs, now)
    assert seen["verdict"].first()["should_rollback"] == seen["report"].first()["drift_flag"]


def test_outcome_report_parts(spark, small):
    from zonetide.plans import proxies as P

    log = P.outcome_log(spark, small)
    parts = jobs.outcome_report(log)
    assert parts["rates"].first()["total_logged"] == log.count() and parts["by_action"].count() == 5 and parts["recent"].count() == 20


def test_every_zone_has_every_hour(spark):
    from pyspark.sql import functions as F

    from zonetide.operators.rollup import every_zone_hour

    zones = spark.createDataFrame([(1, "A"), (2, "B")], "zone_id long, zone_name string")
    facts = spark.createDataFrame([(1, "2024-01-01 00:00:00", 4), (1, "2024-01-01 02:00:00", 7)], "zone_id long, t string, n long")
    facts = facts.select("zone_id", F.col("t").cast("timestamp").alias("timestamp"), "n")
    span = facts.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    out = every_zone_hour(zones, facts, span, {"n": 0}).orderBy("zone_id", "timestamp").collect()
    assert [(r["zone_name"], r["n"]) for r in out] == [("A", 4), ("A", 0), ("A", 7), ("B", 0), ("B", 0), ("B", 0)]
    none = facts.filter("n < 0")
    empty = none.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    assert every_zone_hour(zones, none, empty, {"n": 0}).count() == 0
