"""Drift, alerts and history on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.operators import drift as DR
from zonetide.operators import scoring as SC
from zonetide.streaming.store import BatchTable


def drift_batches(spark, folder: str, score: str = "delay_risk_score"):
    """A ``foreachBatch`` function: compare each batch's scores with the batch before it.

    The first batch has nothing to be compared with and gets no report. Of the scores only those of the last two batches are kept.
    """
    schema = f"{score} double"
    scores, reports = BatchTable(spark, f"{folder}/scores"), BatchTable(spark, f"{folder}/reports")

    def step(batch: DataFrame, number: int) -> None:
        here = scores.replace(batch.select(F.col(score).cast("double").alias(score)), number)
        if number > 0:
            reports.put(DR.score_drift(scores.last(schema, number), here, score).withColumn("batch", F.lit(number).cast("long")), number)

    return step


def drift_reports(spark, folder: str) -> DataFrame:
    """A report for every batch but the first, with its number."""
    return BatchTable(spark, f"{folder}/reports").read()


def first_alerts(alerts: DataFrame, life: str = "24 hours", ts: str = "created_at") -> DataFrame:
    """Each alert id once per ``life``: repeats within it are dropped, state older than it as well."""
    return alerts.withWatermark(ts, life).dropDuplicatesWithinWatermark(["alert_id"])


def history_batches(spark, folder: str, run_ts: Column | None = None, keep: Column | None = None):
    """A ``foreachBatch`` function: append score history with its day, see :class:`BatchTable`.

    ``keep`` (say ``run_day >= date_sub(current_date(), 14)``) is what may stay when folders are merged; all by default. Runs come in by
    time, so the days of a folder are few and a filter on ``run_day`` skips the other files by their statistics.
    """
    table = BatchTable(spark, folder, keep=keep)

    def step(batch: DataFrame, number: int) -> None:
        rows = SC.history_rows(batch, "timestamp" if run_ts is None else run_ts)
        table.put(rows.withColumn("run_day", F.to_date("run_ts")), number)

    return step


def history(spark, folder: str) -> DataFrame:
    """All stored runs."""
    return BatchTable(spark, folder).read()


def recent_history(history: DataFrame, days: int | None = None) -> DataFrame:
    """Rows of runs less than ``days`` older than the newest one (all by default); files of earlier days are not read."""
    if days is None:
        return history
    near = history.filter(F.col("run_day") >= F.date_sub(history.agg(F.max("run_day")).scalar(), days))
    return SC.recent_runs(near, 24 * days)
