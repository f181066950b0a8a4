"""Resolving recommendations while both sides stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.functions.numeric import round_even
from zonetide.functions.scoring import outcome_class


def matched(issued: DataFrame, scores: DataFrame, wait: str = "30 minutes", give_up: str = "24 hours",
            late: str = "10 minutes") -> DataFrame:
    """Scores of the same zone between ``wait`` and ``give_up`` after a recommendation.

    The upper bound lets Spark drop state: a recommendation is kept no longer than ``give_up``.
    ``issued``: recommendation_id, zone_id, logged_at, score_at_time. ``scores``: zone_id, scored_at, score.
    """
    a = issued.withWatermark("logged_at", late).alias("a")
    b = scores.withWatermark("scored_at", late).alias("b")
    return a.join(b, F.expr(f"a.zone_id = b.zone_id AND scored_at >= logged_at + INTERVAL {wait} AND scored_at <= logged_at + INTERVAL {give_up}")).select(
        "recommendation_id", F.col("a.zone_id").alias("zone_id"), "logged_at", "score_at_time", "scored_at", "score")


def first_outcomes(matches: DataFrame) -> DataFrame:
    """The earliest score of each recommendation and its outcome, from the stored matches."""
    first = matches.groupBy("recommendation_id").agg(F.min_by(F.struct("zone_id", "score_at_time", "scored_at", "score"), F.struct("scored_at", "score")).alias("m"))
    return first.select("recommendation_id", "m.zone_id", "m.scored_at", round_even("m.score").alias("score_after"),
                        outcome_class("m.score_at_time", "m.score").alias("outcome"))
