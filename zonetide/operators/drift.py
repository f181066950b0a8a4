"""Population stability, drift reports, rollback rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions.numeric import round_even
from zonetide.functions.scoring import drift_level
from zonetide.operators.enrich import with_defaults

BUCKETS = 10


def stacked(df: DataFrame, columns) -> DataFrame:
    """Numeric columns as (feature, value) rows, nulls dropped."""
    present = [c for c in columns if c in df.columns]
    return (df.select([F.col(c).cast("double").alias(c) for c in present])
            .unpivot([], present, "feature", "value").filter(F.col("value").isNotNull()))


def _bin(v: Column, low: Column, high: Column, buckets: int) -> Column:
    """Equal-width bin, last one closed, settled against the edges themselves at the borders."""
    step = (high - low) / F.lit(float(buckets))
    guess = F.least(F.floor((v - low) / step), F.lit(buckets - 1))
    edge = lambda i: low + i * step
    down = guess - F.when(v < edge(guess), 1).otherwise(0)
    return down + F.when((down < buckets - 1) & (v >= edge(down + 1)), 1).otherwise(0)


def psi(reference: DataFrame, current: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """PSI per feature of two (feature, value) frames, or (feature, value, n) frames of stored counts.

    The shared range and both histograms come from two small aggregations; what is shuffled is at
    most features x 2 x buckets rows per task. Bins empty on both sides add nothing.
    """
    def rows(df: DataFrame, side: int) -> DataFrame:
        times = F.col("n") if "n" in df.columns else F.lit(1)
        return df.select("feature", "value", times.cast("long").alias("n"), F.lit(side).alias("side"))

    def times(side: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))

    both = rows(reference, 0).unionByName(rows(current, 1))
    span = both.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), times(0).alias("n_ref"),
        times(1).alias("n_cur")).filter("n_ref > 0 and n_cur > 0")
    # One row per feature, sent to the values: a join by feature would bring all values of one into a task.
    cells = (both.join(F.broadcast(span.select("feature", "lo", "hi")), "feature").filter(F.col("hi") > F.col("lo"))
             .groupBy("feature", _bin(F.col("value"), F.col("lo"), F.col("hi"), buckets).alias("bin"))
             .agg(times(0).alias("ref"), times(1).alias("cur")))
    part = lambda n, total: F.greatest(F.col(n) / F.col(total), F.lit(1e-6))
    shares = cells.join(span.select("feature", "n_ref", "n_cur"), "feature").select(
        "feature", part("ref", "n_ref").alias("e"), part("cur", "n_cur").alias("a"))
    total = shares.groupBy("feature").agg(
        F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("raw"))
    return span.join(total, "feature", "left").select(
        "feature", F.greatest(F.coalesce("raw", F.lit(0.0)), F.lit(0.0)).alias("psi"), "n_ref", "n_cur")


def _moments(df: DataFrame, tag: str) -> DataFrame:
    return df.groupBy("feature").agg(round_even(F.avg("value")).alias(f"{tag}_mean"),
                                     round_even(F.stddev_samp("value")).alias(f"{tag}_std"))


def drift_report(reference: DataFrame, current: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """PSI, level, flag, means, sample deviations and sizes per feature, and the alert it raises."""
    p = psi(reference, current, buckets)
    joined = p.join(_moments(reference, "reference"), "feature").join(_moments(current, "current"), "feature")
    value = F.col("psi")
    return joined.select(
        "feature", round_even(value).alias("psi"), drift_level(value).alias("drift_level"),
        (value > 0.25).alias("drift_flag"), "reference_mean", "current_mean", "reference_std", "current_std",
        F.col("n_ref").alias("reference_n"), F.col("n_cur").alias("current_n"),
        F.when(value > 0.25, "DRIFT_ALERT").when(value > 0.10, "DRIFT_WARNING").otherwise("").alias("alert_id"))


def score_drift(reference: DataFrame, current: DataFrame, score: str = "delay_risk_score") -> DataFrame:
    """Drift of the score column between two prediction tables."""
    return drift_report(stacked(reference, [score]), stacked(current, [score]))


def feature_drift(reference: DataFrame, current: DataFrame, features=S.DRIFT_FEATURES) -> DataFrame:
    """Drift per monitored feature; features missing on a side are left out."""
    return drift_report(stacked(reference, features), stacked(current, features))


def drift_alerts(report: DataFrame, features: DataFrame | None, now: Column) -> DataFrame:
    """The alert row of a score report; drifted features are named in it."""
    names = F.lit("")
    if features is not None:
        drifted = features.filter(F.col("drift_level") != "stable").agg(
            F.array_join(F.sort_array(F.collect_list("feature")), ", "))
        names = F.coalesce(drifted.scalar(), F.lit(""))
    # Alert wording.
    detail = F.when(names != "", F.concat(F.lit(" (features: "), names, F.lit(")"))).otherwise("")
    text = F.when(F.col("alert_id") == "DRIFT_ALERT", F.concat(
        F.format_string("Prediction drift detected — PSI=%.3f", "psi"), detail)).otherwise(
        F.format_string("Moderate drift detected — PSI=%.3f, level=warning", "psi"))
    return report.filter(F.col("alert_id") != "").select(
        "alert_id", F.when(F.col("alert_id") == "DRIFT_ALERT", "high").otherwise("medium").alias("severity"),
        text.alias("message"), F.lit(None).cast("int").alias("zone_id"), now.alias("created_at"))


def feature_snapshot(df: DataFrame, features=S.DRIFT_FEATURES) -> DataFrame:
    """Mean, sample deviation and count per monitored feature: the next run's reference moments."""
    return stacked(df, features).groupBy("feature").agg(
        round_even(F.avg("value")).alias("mean_value"), round_even(F.stddev_samp("value")).alias("std_value"),
        F.count("value").alias("n"))


def feature_counts(df: DataFrame, features=S.DRIFT_FEATURES) -> DataFrame:
    """How often each value (six decimals) of each feature occurs: what a later PSI needs of this run, every row counted."""
    return (stacked(df, features).groupBy("feature", round_even(F.col("value"), 6).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def rollback_rule(runs: DataFrame, failed_above: float = 0.20, psi_above: float = 0.25) -> DataFrame:
    """Whether each run calls for a rollback, and why."""
    df = with_defaults(runs, {"rows_scored": 0, "failed_rows": 0, "psi": 0.0, "drift_flag": False})
    rate = F.when(F.col("rows_scored") > 0, F.col("failed_rows") / (F.col("rows_scored") + F.col("failed_rows")))
    by_rows = F.coalesce(rate > failed_above, F.lit(False))
    by_drift = (F.col("psi") > psi_above) | F.col("drift_flag")
    # Reason wording.
    wording = f"failed row pct %.1f%% > {failed_above * 100:.0f}%%"
    why = (F.when(by_rows, F.format_string(wording, round_even(rate * F.lit(100.0), 1)))
           .when(by_drift, F.format_string(f"PSI drift %.3f > {psi_above}", round_even("psi", 3))).otherwise(""))
    return df.withColumns({"should_rollback": by_rows | by_drift, "rollback_reason": why})


def failed_row_alerts(runs: DataFrame, above: float = 0.10) -> DataFrame:
    """Alert rows for runs where failed / scored is too high (a different rate from the rollback rule)."""
    scored = F.greatest(F.coalesce("rows_scored", F.lit(1)), F.lit(1))
    rate = F.coalesce("failed_rows", F.lit(0)) / scored
    return runs.filter(rate > above).select(
        F.lit("HIGH_FAILED_ROWS").alias("alert_id"), F.lit("medium").alias("severity"),
        F.concat(F.col("failed_rows").cast("string"), F.lit(" rows failed validation in latest batch ("),
                 F.rint(rate * F.lit(100.0)).cast("int").cast("string"), F.lit("%)")).alias("message"),
        F.lit(None).cast("int").alias("zone_id"), F.col("timestamp").alias("created_at"))
