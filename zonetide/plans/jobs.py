"""End-to-end jobs: hourly scoring, training, monitoring, the outcome report.

Each job strings operators together and stores what the next one reads. Nothing is collected;
whatever a later step reads more than once is a stored table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.learning import models as ML
from zonetide.learning.splits import time_split
from zonetide.operators import cards as C
from zonetide.operators import decision as D
from zonetide.operators import drift as DR
from zonetide.operators import enrich as E
from zonetide.operators import features as FT
from zonetide.operators import outcomes as O
from zonetide.operators import quality as QL
from zonetide.operators import rollup as R
from zonetide.operators import scoring as SC
from zonetide.session import written
from zonetide.settings import DecisionSettings
from zonetide.sources import writers as WR


@dataclass(frozen=True)
class ScoringTables:
    """What an hourly run leaves behind."""

    predictions: DataFrame
    failed: DataFrame
    decisions: DataFrame
    cards: DataFrame
    opened: DataFrame
    kpis: DataFrame
    drift: DataFrame | None


def zone_hours(snapshots: DataFrame, weather: DataFrame | None = None, carparks: DataFrame | None = None,
               congestion: DataFrame | None = None) -> DataFrame:
    """Snapshots to zone-hours with weather, aligned carparks and congestion, and the calendar."""
    hourly = R.hourly_mean(snapshots)
    out = E.with_weather(hourly, weather) if weather is not None else E.with_defaults(hourly, S.WEATHER_DEFAULTS)
    for table, column in ((carparks, "carpark_available_lots"), (congestion, "congestion_ratio")):
        default = {column: S.EXTERNAL_DEFAULTS[column]}
        if table is None:
            out = E.with_defaults(out, default)
        elif "timestamp" in table.columns:
            out = E.with_zone_hour_values(out, table, default)
        else:
            out = E.with_latest_zone_values(out, table, default)
    return FT.calendar_features(out).drop("is_eve_holiday", "is_school_holiday")


def score_run(hours: DataFrame, edges: DataFrame, now: Column, model=None, risk: Column | None = None,
              groups: list[str] | None = None, cfg: DecisionSettings = DecisionSettings(), last: DataFrame | None = None,
              carried: DataFrame | None = None, reference: DataFrame | None = None) -> ScoringTables:
    """Validate, build features, score, decide, write cards and compare with the reference scores.

    ``model`` is a fitted classifier over the model features; ``risk`` an expression instead of one.
    ``reference`` is the previous run's prediction table, never this one's.
    """
    checked = written(QL.tagged(hours), "checked")
    clean = checked.filter(F.col(QL.REASON) == "").drop(QL.REASON)
    failed = checked.filter(F.col(QL.REASON) != "")
    rows = FT.build_features(clean)
    if model is not None:
        wanted = FT.model_columns(rows)
        rows = ML.scores(model, ML.assembled(rows, wanted, "features")).drop("features")
        risk = F.col("p")
    predictions = written(SC.score_table(rows, risk), "predictions")
    day = F.to_date("timestamp")
    decisions = written(D.decide_zones(predictions.withColumn("day", day), edges, now, groups or ["day"], cfg, last, carried), "decisions")
    cards = C.cards(decisions, now)
    drift = None if reference is None else DR.score_drift(reference, predictions)
    return ScoringTables(predictions, failed, decisions, cards, C.open_outcomes(cards, now), SC.run_kpis(predictions), drift)


def store_run(tables: ScoringTables, folder: str, run_id: str) -> None:
    """Store a run in the tables of a folder. Each table has a partition per run, so a retried run replaces its own rows."""
    part = f"run_id={run_id}"
    WR.write_predictions(tables.predictions, f"{folder}/predictions", run_id)
    WR.write_failed_rows(tables.failed, f"{folder}/failed_rows/{part}")
    WR.write_table(tables.cards, f"{folder}/cards/{part}")
    WR.write_table(tables.opened, f"{folder}/issued/{part}")
    WR.append_log(tables.kpis, f"{folder}/runs/{part}", mode="overwrite")


def train_run(hours: DataFrame, estimator=None):
    """Label, split by time, fit, judge. Returns (model, features used, metrics)."""
    rows = FT.next_hour_label(FT.build_features(hours), drop_last=True)
    wanted = FT.model_columns(rows)
    stored = written(time_split(rows).select("zone_id", "timestamp", "supply_shortage", "is_train", *wanted), "training")
    model, held = ML.train(stored, wanted, "supply_shortage", estimator=estimator)
    from zonetide.operators.metrics import evaluate

    return model, wanted, evaluate(held, "label")


def monitor_run(previous: DataFrame, current: DataFrame, runs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Drift of the newest run against the one before, its alerts, and the rollback verdict."""
    features = [f for f in S.DRIFT_FEATURES if f in previous.columns and f in current.columns]
    report = written(DR.score_drift(previous, current), "drift")
    per_feature = DR.feature_drift(previous, current, features)
    judged = DR.rollback_rule(runs.drop("psi", "drift_flag").withColumns({
        "psi": F.coalesce(report.select("psi").limit(1).scalar(), F.lit(0.0)),
        "drift_flag": F.coalesce(report.select("drift_flag").limit(1).scalar(), F.lit(False))}))
    return {"report": report, "features": per_feature, "alerts": DR.drift_alerts(report, per_feature, now), "verdict": judged}


def outcome_report(records: DataFrame, days: int | None = None) -> dict[str, DataFrame]:
    """All parts of the outcome report over all records, or over those of the last ``days``."""
    window = written(O.recent_records(records, days), "outcome-window")
    return {"rates": O.outcome_rates(window), "by_action": O.effectiveness_by_action(window),
            "by_follow_status": O.effectiveness_by_follow_status(window), "by_zone": O.zone_interventions(window),
            "top_contexts": O.top_contexts(window), "recent": O.recent_outcomes(window)}


def training_hours(spark: SparkSession, snapshot_folder: str, **context: DataFrame) -> DataFrame:
    """Zone-hours of a folder of snapshot files."""
    from zonetide.sources.readers import read_snapshots

    return zone_hours(read_snapshots(spark, snapshot_folder), **context)
