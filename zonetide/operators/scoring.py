"""From features and a risk score to the prediction table, and run-level numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions import scoring as X
from zonetide.functions.numeric import clip, count_where, round_even, share
from zonetide.operators.enrich import with_defaults

RISK = "delay_risk_score"


def score_table(features: DataFrame, risk: Column | str) -> DataFrame:
    """Prediction rows: risk, pressure, imbalance, shortage, policy and explanation.

    Pure projections, so Spark fuses them with whatever produced the features.
    """
    have = set(features.columns)
    value = F.col(risk) if isinstance(risk, str) else risk
    df = with_defaults(features, S.PRESSURE_DEFAULTS, fill=False)
    baseline = F.coalesce(F.col("taxi_lag_24h"), F.col("taxi_count")) if "taxi_lag_24h" in have else F.col("taxi_count")
    df = df.withColumns({
        RISK: round_even(value),
        "explanation_tag": X.explanation_tag(have),
        "demand_pressure_score": round_even(X.demand_pressure()),
        "baseline_supply": round_even(baseline.cast("double"))})
    df = df.withColumns({
        "depletion_risk_score": F.col(RISK),
        "risk_level": X.level(RISK),
        "demand_pressure_level": X.level("demand_pressure_score"),
        "imbalance_score": X.imbalance("demand_pressure_score", "taxi_count", "baseline_supply"),
        "predicted_shortage": X.predicted_shortage("demand_pressure_score", "taxi_count", RISK, "baseline_supply")})
    df = df.withColumns({
        "imbalance_level": X.imbalance_level("imbalance_score"),
        "policy_action": X.policy_action(RISK, "imbalance_score", "taxi_count"),
        "policy_reason": X.policy_reason(RISK, "imbalance_score", "taxi_count")})
    wanted = ["zone_id", "zone_name", "region", "timestamp", RISK, "depletion_risk_score", "risk_level", "taxi_count",
              "depletion_rate_1h", "supply_vs_yesterday", "explanation_tag", "demand_pressure_score",
              "demand_pressure_level", "baseline_supply", "imbalance_score", "imbalance_level", "policy_action",
              "policy_reason", "predicted_shortage"]
    return df.select(*[c for c in wanted if c in df.columns])


def latest_snapshot(df: DataFrame, ts: str = "timestamp", newest: Column | None = None) -> DataFrame:
    """Rows of the newest timestamp.

    The maximum is a scalar subquery, pushed to the scan when ``df`` is a table. For a long derived
    plan pass ``newest`` taken from its source, so that the plan is not run twice for it.
    """
    return df.filter(F.col(ts) == (df.agg(F.max(ts)).scalar() if newest is None else newest))


def flagged(df: DataFrame, at_least: float = 0.40, score: str = RISK) -> DataFrame:
    return df.filter(F.col(score) >= at_least)


def score_stats(df: DataFrame, score: str = RISK, high: float = 0.70) -> DataFrame:
    """Mean, population deviation, median, p90, share of high scores and count, one row.

    Scores carry four decimals, so the exact percentile sees at most 10,001 distinct values.
    """
    s = F.round(F.col(score), 4)
    return df.agg(round_even(F.avg(score)).alias("score_mean"), round_even(F.stddev_pop(score)).alias("score_std"),
                  round_even(F.percentile(s, 0.5)).alias("score_p50"), round_even(F.percentile(s, 0.9)).alias("score_p90"),
                  round_even(F.avg((F.col(score) >= high).cast("double"))).alias("pct_high_risk"),
                  F.count(score).alias("n_scored"))


def score_counts(df: DataFrame, score: str = RISK) -> DataFrame:
    """How often each score (six decimals) occurs: the stored drift reference, in which every row counts."""
    return df.groupBy(round_even(score, 6).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def run_kpis(df: DataFrame, score: str = RISK, high: float = 0.70, medium: float = 0.40,
             latest: Column | None = None) -> DataFrame:
    """Run-level KPIs over all rows and over the newest snapshot (``latest``), in one row."""
    at = df.agg(F.max("timestamp")).scalar() if latest is None else latest
    s, newest = F.col(score), F.col("timestamp") == at
    lost = F.when(s >= medium, clip("depletion_rate_1h", 0.0, 1.0))
    return df.agg(
        F.count(F.lit(1)).alias("rows_scored"),
        count_where(s >= medium).alias("flagged_zones"),
        round_even(F.lit(1.0) - F.coalesce(F.avg((s >= high).cast("double")), F.lit(0.0))).alias("fulfilment_rate"),
        round_even(F.coalesce(F.avg(lost) * F.lit(20.0), F.lit(0.0)), 2).alias("avg_delay_min"),
        F.coalesce(F.sum("taxi_count"), F.lit(0)).alias("total_taxi_count"),
        count_where(newest & (s >= high)).alias("high_risk_zones_now"),
        F.coalesce(F.sum(F.when(newest, F.col("taxi_count"))), F.lit(0)).alias("supply_now"),
        count_where(newest & (F.col("depletion_rate_1h") > 0.30)).alias("rapid_depletion_zones"),
        round_even(F.avg("demand_pressure_score")).alias("avg_demand_pressure_score"),
        round_even(F.avg("imbalance_score")).alias("avg_imbalance_score"))


def overview_kpis(now_rows: DataFrame, cards: DataFrame, psi: Column, since: Column) -> DataFrame:
    """Dashboard header: levels, supply, rapid depletion, urgent cards, drift, age of the last run."""
    urgent = cards.agg(count_where(F.col("priority").isin("critical", "high"))).scalar()
    return now_rows.agg(
        count_where(F.col("risk_level") == "high").alias("high_risk_zone_count"),
        count_where(F.col("risk_level") == "medium").alias("medium_risk_zone_count"),
        F.coalesce(F.sum("taxi_count"), F.lit(0)).alias("total_taxi_supply"),
        count_where(F.col("depletion_rate_1h") > 0.30).alias("rapid_depletion_zones")).withColumns({
            "critical_actions_count": urgent, "model_psi": round_even(psi), "minutes_since_last_run": since})


def level_summary(now_rows: DataFrame, score: str = RISK) -> DataFrame:
    """Zones per risk level with shares in percent, and the mean score."""
    counted = now_rows.agg(
        F.count(F.lit(1)).alias("zones"), count_where(F.col("risk_level") == "high").alias("high"),
        count_where(F.col("risk_level") == "medium").alias("medium"),
        count_where(F.col("risk_level") == "low").alias("low"), round_even(F.avg(score)).alias("avg_risk"))
    return counted.withColumns({f"{k}_pct": round_even(share(k, "zones", 6) * F.lit(100.0), 1)
                                for k in ("high", "medium", "low")})


def history_rows(df: DataFrame, run_ts: Column | str = "timestamp", score: str = RISK,
                 order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """Score history in long form: the last row per run and zone."""
    run = F.col(run_ts) if isinstance(run_ts, str) else run_ts
    last = F.max_by(F.struct(round_even(score).alias("score"), F.col("taxi_count").alias("taxi_count")), F.struct(*order))
    return (df.groupBy(run.alias("run_ts"), "zone_id").agg(last.alias("s"))
            .select("run_ts", "zone_id", "s.score", "s.taxi_count"))


def history_maps(history: DataFrame) -> DataFrame:
    """One row per run with zone -> score and zone -> count maps; as many entries as there are zones."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("zone_id").cast("string").alias("k"), "score", "taxi_count")))
    return (history.groupBy("run_ts").agg(pairs.alias("p"))
            .select("run_ts", F.map_from_entries(F.transform("p", lambda e: F.struct(e["k"], e["score"]))).alias("zones"),
                    F.map_from_entries(F.transform("p", lambda e: F.struct(e["k"], e["taxi_count"]))).alias("taxi_counts")))


def recent_runs(history: DataFrame, hours: int | None = None, newest: Column | None = None, run: str = "run_ts") -> DataFrame:
    """Rows of the runs less than ``hours`` older than the newest one; all rows without ``hours``.

    As with ``latest_snapshot``, pass ``newest`` where ``history`` is a long derived plan.
    """
    if hours is None:
        return history
    last = history.agg(F.max(run)).scalar() if newest is None else newest
    return history.filter(F.col(run) > last - F.make_interval(hours=F.lit(hours)))


def zone_history(maps: DataFrame, zone_id: int, field: str = "zones", hours: int | None = None, newest: Column | None = None) -> DataFrame:
    """A zone's values over the runs of a time range (all by default), from the map form; runs without the zone are skipped."""
    return (recent_runs(maps, hours, newest).select(F.col("run_ts").alias("timestamp"),
                                           F.col(field).getItem(str(zone_id)).alias("value"))
            .filter(F.col("value").isNotNull()))
