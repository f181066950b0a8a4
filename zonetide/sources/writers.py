"""Sinks. Every writer keeps Spark's parallel output: a folder of part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.operators.quality import REASON
from zonetide.sources.folders import Folder

FAILED_HEADER = ("zone_id", "timestamp", REASON)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_predictions(df: DataFrame, path: str, run_id: str) -> None:
    """Prediction rows of a run, partitioned by run and day; a retry replaces the run, a reader of recent days skips the rest."""
    out = df.withColumn("run_date", F.to_date("timestamp"))
    out.write.mode("overwrite").partitionBy("run_date").parquet(f"{path}/run_id={run_id}")


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with a header in every part file; quotes inside values are doubled."""
    (df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"')
     .option("emptyValue", "").csv(path))


def write_timed_files(df: DataFrame, path: str, stamp: str = "snap_ts", tz: str = S.LOCAL_TIMEZONE) -> None:
    """One CSV file a snapshot, named by its local time like 2026-04-17_08-30.csv, as ``readers.read_timed_files`` expects.

    Snapshots are written side by side; the driver only renames the files.
    """
    local = F.date_format(F.from_utc_timestamp(stamp, tz), "yyyy-MM-dd_HH-mm")
    (df.withColumn("_name", local).drop(stamp).repartition("_name").write.mode("overwrite").option("header", True).option("escape", '"')
     .partitionBy("_name").csv(path))
    folder = Folder(df.sparkSession, path)
    for below in folder.names():
        if below.startswith("_name="):
            (part,) = [n for n in folder.names(below) if n.startswith("part-")]  # one task wrote the snapshot
            folder.rename(f"{below}/{part}", below.removeprefix("_name=") + ".csv")
            folder.drop(below)


def write_failed_rows(failed: DataFrame, path: str) -> None:
    """Failed rows; an empty result still leaves a readable table with its three columns."""
    keep = failed
    for c in FAILED_HEADER:
        if c not in failed.columns:
            keep = keep.withColumn(c, F.lit(None).cast("string"))
    keep.write.mode("overwrite").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str, now: Column | None = None, mode: str = "append") -> None:
    """Append log rows as JSON lines, stamped when ``now`` is given."""
    out = rows if now is None else rows.withColumn("logged_at", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    out.write.mode(mode).option("ignoreNullFields", False).json(path)


def audit_event(spark, event: str, from_version: str, to_version: str | None, reason: str, run_id: str, at: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(event).alias("event"), F.lit(from_version).alias("from_version"), F.lit(to_version).cast("string").alias("to_version"),
        F.lit(reason).alias("reason"), F.lit(run_id).alias("run_id"), F.lit(at).alias("timestamp"))


def json_text(df: DataFrame, columns: list[str], out: str = "json") -> DataFrame:
    """Rows as JSON text with NaN and infinities as null."""
    kinds = dict(df.dtypes)
    safe = [F.when(F.isnan(c) | F.abs(F.col(c)).isin(float("inf")), None).otherwise(F.col(c)).alias(c)
            if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    return df.withColumn(out, F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}))


def export_history(runs: DataFrame, path: str) -> None:
    """The run log as one flat CSV table (columns are the union over all runs)."""
    write_csv(runs, path)
