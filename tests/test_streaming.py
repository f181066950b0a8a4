from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from zonetide.operators import decision as D
from zonetide.settings import DecisionSettings
from zonetide.streaming import ingest, monitor, outcomes, state, windows
from zonetide.streaming.store import BatchTable


def _files(df, path, n):
    """One file per slice, written in order."""
    for i in range(n):
        df.filter(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(path)


def test_windows_over_many_files_match_batch(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").select(F.col("ts").cast("timestamp").alias("timestamp"), (F.col("user_id") % 5 + 1).alias("zone_id"), "user_id")
    sliced = e.withColumn("slice", F.floor((F.unix_timestamp("timestamp") - 1704067200) / (86400 * 6)).cast("int"))
    _files(sliced, str(tmp_path / "in"), 5)
    stream = ingest.file_stream(spark, str(tmp_path / "in"), e.schema, max_files=1)
    query = ingest.start(windows.tumbling_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    got = {(r["zone_id"], r["timestamp"]): r["taxi_count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    closed = e.agg(F.max("timestamp") - F.expr("interval 75 minutes")).first()[0]
    every = {(r["zone_id"], r["h"]): r["count"] for r in e.groupBy("zone_id", F.date_trunc("hour", "timestamp").alias("h")).count().collect()}
    assert got == {k: n for k, n in every.items() if k[1] <= closed} != every
    # The same stream, closed: nothing is held back.
    folder = str(tmp_path / "closing")
    out = ingest.caught_up(windows.tumbling_counts(ingest.closable(stream, "timestamp", folder)), "closed", closing=("timestamp", folder))
    assert {(r["zone_id"], r["timestamp"]): r["taxi_count"] for r in out.collect()} == every


def test_complete_mode_keeps_the_last_result(spark, tmp_path):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), (F.col("id") % 2).cast("int").alias("slice"))
    _files(df, str(tmp_path / "in"), 2)
    stream = ingest.file_stream(spark, str(tmp_path / "in"), "k long", max_files=1)
    out = ingest.caught_up(stream.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "complete", "complete")
    assert {r["k"]: r["n"] for r in out.collect()} == {0: 5, 1: 5}


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    """Over more batches than a query's progress remembers; a retried batch counts once."""
    step = ingest.late_batches(spark, str(tmp_path), wait="10 minutes")

    def batch(*minutes):
        rows = [(m,) for m in minutes]
        return spark.createDataFrame(rows, "m int").select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("m"))).alias("timestamp"), "m")

    want = {}
    for n in range(104):
        minutes = (n, n - 11) if n % 3 == 0 else (n, n - 5)  # the second row comes eleven minutes after the newest one before, or five
        step(batch(*minutes), n)
        want[n] = sum(m < n - 1 - 10 for m in minutes) if n else 0
    step(batch(103, 98), 103)
    counts = {r["batch"]: (r["rows"], r["late"]) for r in ingest.late_counts(spark, str(tmp_path)).collect()}
    assert counts == {n: (2, late) for n, late in want.items()}
    rows = ingest.kept_rows(spark, str(tmp_path)).collect()
    assert len(rows) == 208 and {n: sum(r["late"] for r in rows if r["batch"] == n) for n in want} == want


def _files_below(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet"))


def test_batch_tables_stay_small_and_replaceable(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "n long", every=3)
    assert table.read().count() == 0
    seen = []
    for n in range(50):
        table.put(spark.createDataFrame([(n,), (n + 1000,)], "n long").coalesce(1), n)
        if n in (8, 26, 40):
            table.put(spark.createDataFrame([(n,)], "n long").coalesce(1), n)  # a retry that brings something else
        seen.append(len(_files_below(tmp_path / "t")))
    assert sorted(r["n"] for r in table.read().collect()) == sorted([*range(50), *[n + 1000 for n in range(50) if n not in (8, 26, 40)]])
    assert max(seen) < 16 and len(list((tmp_path / "t/manifest").glob("[0-9]*"))) == 2
    old = BatchTable(spark, str(tmp_path / "k"), "n long", every=3, keep=F.col("n") >= 10)
    state = BatchTable(spark, str(tmp_path / "s"), "n long")
    for n in range(12):
        old.put(spark.createDataFrame([(n,)], "n long"), n)
        before = state.last("n long", n).collect()
        assert [r["n"] for r in before] == ([n - 1] if n else [])
        state.replace(spark.createDataFrame([(n,)], "n long").coalesce(1), n)
    assert sorted(r["n"] for r in old.read().collect()) == [10, 11]  # the rest has expired and was left out of merged folders
    assert len(_files_below(tmp_path / "s")) == 2
    assert [r["n"] for r in state.last("n long", 11).collect()] == [10]  # a retry of the last batch finds what it found


def test_outcomes_match_batch_rule(spark, tmp_path):
    issued = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00", 0.8), ("b", 1, "2024-01-01 02:00:00", 0.8)], "recommendation_id string, zone_id long, t string, score_at_time double").select(
        "recommendation_id", "zone_id", F.col("t").cast("timestamp").alias("logged_at"), "score_at_time")
    scores = spark.createDataFrame([(1, "2024-01-01 00:29:00", 0.1), (1, "2024-01-01 00:30:00", 0.75), (1, "2024-01-01 00:45:00", 0.1)], "zone_id long, t string, score double").select(
        "zone_id", F.col("t").cast("timestamp").alias("scored_at"), "score")
    issued.write.parquet(str(tmp_path / "i"))
    scores.write.parquet(str(tmp_path / "s"))
    m = outcomes.matched(ingest.file_stream(spark, str(tmp_path / "i"), issued.schema), ingest.file_stream(spark, str(tmp_path / "s"), scores.schema))
    rows = outcomes.first_outcomes(ingest.caught_up(m, "out")).collect()
    assert [(r["recommendation_id"], r["score_after"], r["outcome"]) for r in rows] == [("a", 0.75, "unchanged")]


def test_alerts_pass_once_per_day(spark, tmp_path):
    rows = [("A", "2024-01-01 00:00:00"), ("A", "2024-01-01 01:00:00"), ("B", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "alert_id string, t string").select("alert_id", F.col("t").cast("timestamp").alias("created_at")).write.parquet(str(tmp_path / "a"))
    out = ingest.caught_up(monitor.first_alerts(ingest.file_stream(spark, str(tmp_path / "a"), "alert_id string, created_at timestamp")), "alerts")
    assert sorted(r["alert_id"] for r in out.collect()) == ["A", "B"]


def test_runs_carry_from_batch_to_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(z, n, 0.9 if rnd.random() < 0.8 else 0.1, n // 30) for z in (1, 2) for n in range(90)]
    df = spark.createDataFrame(rows, "zone_id long, n int, predicted_shortage double, slice int").select(
        "zone_id", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("n"))).alias("timestamp"), "predicted_shortage", "slice")
    _files(df, str(tmp_path / "in"), 3)
    stream = ingest.file_stream(spark, str(tmp_path / "in"), "zone_id long, timestamp timestamp, predicted_shortage double", max_files=1)
    ingest.run_batches(stream, state.persistence_batches(spark, str(tmp_path / "st")), str(tmp_path / "ck"))
    cols = ["zone_id", "timestamp", "persistence_count"]
    got = sorted(map(tuple, BatchTable(spark, str(tmp_path / "st/rows")).read().select(cols).collect()))
    want = sorted(map(tuple, D.persistence_counts(df, F.col("predicted_shortage") > 0.25).select(cols).collect()))
    assert got == want


def _decision_rows(spark, hours, zones=4, seed=1):
    rnd = random.Random(seed)
    rows = [(z, f"Zone{z}", "ab"[z % 2], n, rnd.choice([0.2, 0.5, 0.7, 0.9]), rnd.randint(1, 60), 20.0) for n in range(hours) for z in range(1, zones + 1)]
    schema = "zone_id long, zone_name string, region string, n int, predicted_shortage double, taxi_count int, baseline_supply double"
    start = F.lit("2024-01-01 18:00:00").cast("timestamp")
    return spark.createDataFrame(rows, schema).withColumn("timestamp", start + F.make_interval(mins=F.col("n") * 20)).drop("n"), rows


CFG = replace(DecisionSettings(daily_budget=6.0), cost_weight=0.05)
EDGES = [("Zone1", "Zone2"), ("Zone1", "Zone3"), ("Zone2", "Zone1"), ("Zone3", "Zone4"), ("Zone4", "Zone1")]


def _one_by_one(rows, groups, cfg):
    """The decisions as one process would take them, row by row."""
    runs, acted, spent, supply, out = {}, {}, {}, {}, {}
    even = lambda x: round(x + 0.0, 4)
    for n in sorted({r[3] for r in rows}):
        now = [r for r in rows if r[3] == n]
        for z, *_, tc, base in now:
            supply[f"Zone{z}"] = max(tc - max(base * 0.8, 1.0), 0.0) / base
        minute = 18 * 60 + n * 20
        day = minute // 1440
        for z, name, region, _, s, _, _ in sorted(now):
            runs[z] = runs.get(z, 0) + 1 if s > cfg.monitor_max else 0
            surplus = even(sum(supply[b] for a, b in EDGES if a == name))
            key = (day, region) if "region" in groups else day
            left = max(cfg.daily_budget - spent.get(key, 0), 0)
            bucket = "low" if s <= 0.25 else "moderate" if s <= 0.55 else "severe" if s >= 0.85 else "high"
            best = []
            for i, a in enumerate(cfg.actions):
                gain = even(max(0.0, min(s * a.uplift * (min(max(surplus, 0), 1) if a.needs_surplus else 1) * a.boost, s)))
                net = even(gain - a.cost * cfg.cost_weight - (cfg.alert_penalty if a.name == cfg.alert_action else 0))
                cooling = a.cooldown_minutes > 0 and (z, i) in acted and minute - acted[z, i] < a.cooldown_minutes
                fits = a.name in cfg.candidates[bucket] and not cooling and (not a.spends_budget or left >= a.cost - 1e-9)
                if fits and (surplus > 0 or not a.needs_surplus) and (a.always_allowed or runs[z] >= cfg.persistence_threshold):
                    best.append((net, -i))
            taken = -max(best)[1] if best else (4 if bucket == "severe" else 0)
            acted[z, taken] = minute
            spent[key] = spent.get(key, 0) + (cfg.actions[taken].cost if cfg.actions[taken].spends_budget else 0)
            out[z, n] = (cfg.actions[taken].name, round(left, 4), runs[z], surplus)
    return out


@pytest.mark.parametrize("groups", [["day"], ["region", "day"]])
def test_decisions_do_not_depend_on_how_rows_are_cut_into_batches(spark, tmp_path, groups):
    """Cuts inside days and inside moments, rows of a batch in any order, a retried batch: as one by one."""
    df, rows = _decision_rows(spark, 30)
    edges = spark.createDataFrame(EDGES, "zone string, neighbor string")
    want = _one_by_one(rows, groups, CFG)
    taken = {a for a, *_ in want.values()}
    assert {"incentive", "rebalance"} <= taken and len({left for _, left, *_ in want.values()}) > 4
    end = spark.range(1).select(F.lit(ingest.CLOSING).cast("timestamp").alias("timestamp"))
    place = F.unix_timestamp("timestamp") * 10 + F.col("zone_id")
    first = df.agg(F.min(place)).first()[0]
    for name, cuts in [("five", [3, 12_003, 130_002, 240_000, 240_004])] + ([("one", [])] if groups == ["day"] else []):
        step = state.decide_batches(spark, str(tmp_path / name), edges, groups, CFG)
        bounds = [-1, *[first + c for c in cuts], 1 << 60]
        for number, (low, high) in enumerate(zip(bounds, bounds[1:])):
            batch = df.filter((place > low) & (place <= high)).orderBy(F.rand(7))
            step(batch, number)
            if number == 2:
                step(batch, number)
        step(df.limit(0).unionByName(end, allowMissingColumns=True), len(bounds) - 1)
        found = state.decisions(spark, str(tmp_path / name)).withColumn("n", (F.unix_timestamp("timestamp") - F.unix_timestamp(F.lit("2024-01-01 18:00:00").cast("timestamp"))) / 1200)
        got = {(r["zone_id"], int(r["n"])): (r["recommended_action"], round(r["remaining_budget"], 4), r["persistence_count"], r["neighbor_surplus"]) for r in found.collect()}
        assert got == want


def test_rows_behind_a_decided_moment_are_kept_as_late(spark, tmp_path):
    df, _ = _decision_rows(spark, 4)
    edges = spark.createDataFrame(EDGES, "zone string, neighbor string")
    step = state.decide_batches(spark, str(tmp_path), edges, ["day"], CFG)
    late = F.unix_timestamp("timestamp") == df.agg(F.min(F.unix_timestamp("timestamp"))).scalar()
    step(df.filter(~late), 0)
    step(df.filter(late), 1)
    assert BatchTable(spark, str(tmp_path / "late")).read().count() == 4
    assert state.decisions(spark, str(tmp_path)).count() == 8 and BatchTable(spark, str(tmp_path / "waiting")).read().count() == 4


def test_drift_and_history_batches(spark, tmp_path):
    a = spark.range(200).select((F.col("id") / 1000.0).alias("delay_risk_score"))
    step = monitor.drift_batches(spark, str(tmp_path / "d"))
    step(a, 0)
    step(a.select((F.col("delay_risk_score") + 0.7).alias("delay_risk_score")), 1)
    rows = monitor.drift_reports(spark, str(tmp_path / "d")).collect()
    assert len(rows) == 1 and rows[0]["drift_level"] == "alert"
    keep = monitor.history_batches(spark, str(tmp_path / "h"))
    for n in range(3):
        keep(spark.range(2).select(F.col("id").alias("zone_id"), F.lit(0.5).alias("delay_risk_score"), F.lit(1).alias("taxi_count"),
                                   F.lit(f"2024-01-0{n + 1}").cast("timestamp").alias("timestamp")), n)
    assert monitor.recent_history(monitor.history(spark, str(tmp_path / "h")), 2).count() == 4
