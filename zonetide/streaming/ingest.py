"""Sources, sinks and triggers.

A polling loop becomes a file stream: whatever drops snapshot files into a folder, each file is
read once, in the background or until nothing is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zonetide.functions import clock
from zonetide.session import scratch_path, written
from zonetide.sources import schemas
from zonetide.streaming.store import BatchTable, run_together


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None, **options) -> DataFrame:
    """New files of a folder (or glob) as a stream, with a fixed schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def snapshot_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Snapshot CSVs as they arrive, typed like the batch reader."""
    raw = file_stream(spark, path, schemas.SNAPSHOT_TEXT, "csv", max_files, header=True)
    return raw.withColumns({"zone_id": F.col("zone_id").try_cast("int"), "taxi_count": F.col("taxi_count").try_cast("int"),
                            "timestamp": clock.parse_iso("timestamp")})


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None,
          fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Write a stream to files. ``every`` keeps it running ('5 minutes'); without it, it stops when caught up."""
    writer = stream.writeStream.outputMode(mode).format(fmt).option("checkpointLocation", checkpoint).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


#: The time of a row that closes a stream: later than any window or wait that may still be open.
CLOSING = "9999-01-01 00:00:00"


def closable(stream: DataFrame, ts: str, folder: str) -> DataFrame:
    """The stream together with ``folder``, into which :func:`close` puts a row that has nothing but a time.

    Such a row has nulls in all other columns, and ``ts`` in the far future: its own windows are never finished, so it does not show up
    in windowed results; other results can tell it by its nulls.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], f"{ts} timestamp").write.mode("ignore").parquet(folder)
    return stream.unionByName(file_stream(spark, folder, f"{ts} timestamp"), allowMissingColumns=True)


def close(spark: SparkSession, ts: str, folder: str) -> None:
    """Say that nothing more will come: the next batch moves the watermark past everything that is still open."""
    spark.range(1).select(F.lit(CLOSING).cast("timestamp").alias(ts)).write.mode("overwrite").parquet(folder)


def caught_up(stream: DataFrame, label: str, mode: str = "append", closing: tuple[str, str] | None = None) -> DataFrame:
    """Run a stream until its source is exhausted and return what it wrote, as a table in the shared folder.

    ``closing`` (time column and folder of :func:`closable`) says that the source is at its end: the stream goes on from its checkpoint
    with the closing row and also writes what it was still holding.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    if mode == "append":
        start(stream, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
        if closing:
            close(spark, *closing)
            start(stream, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/rows")
    return _newest_result(stream, root, mode)


def run_batches(stream: DataFrame, step, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Feed micro-batches to ``step(batch, number)``; without ``every`` until the source is exhausted."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()
    return query


def _newest_result(stream: DataFrame, root: str, mode: str) -> DataFrame:
    """Complete results replace the stored table with every batch; the last one stands."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.parquet(f"{root}/rows-start")
    written_to = [f"{root}/rows-start"]

    def store(batch: DataFrame, number: int) -> None:
        at = f"{root}/rows-{number}"
        batch.write.mode("overwrite").parquet(at)
        written_to.append(at)

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
             .foreachBatch(store).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(written_to[-1])


LATENESS = "batch long, watermark timestamp, rows long, late long"


def late_batches(spark: SparkSession, folder: str, ts: str = "timestamp", wait: str = "15 minutes"):
    """A ``foreachBatch`` function that keeps rows from behind the watermark instead of dropping them.

    The watermark of a batch is the latest time in any batch before it, less ``wait``. Rows go to ``folder/rows``, those older than
    the watermark marked ``late``; ``folder/counts`` has a row for every batch. A retried batch replaces its own folders.
    """
    state = BatchTable(spark, f"{folder}/latest")
    counts, rows = BatchTable(spark, f"{folder}/counts", LATENESS), BatchTable(spark, f"{folder}/rows")

    def step(batch: DataFrame, number: int) -> None:
        before = state.last("latest timestamp", number)
        mark = before.agg(F.max(F.col("latest") - F.expr(f"INTERVAL {wait}"))).scalar()
        late = F.coalesce(F.col(ts) < mark, F.lit(False))
        kept = written(batch.withColumn("late", late).withColumn("batch", F.lit(number).cast("long")), "batch-rows")
        told = written(kept.agg(F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"), F.max(ts).alias("latest")), "batch-counts")
        told_rows = told.select(F.lit(number).cast("long").alias("batch"), mark.alias("watermark"), "rows", "late")
        latest = told.select("latest").unionByName(before).agg(F.max("latest").alias("latest"))
        run_together(spark, lambda: rows.put(kept, number), lambda: counts.put(told_rows, number), lambda: state.replace(latest, number))

    return step


def kept_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of :func:`late_batches` with ``late`` and ``batch``."""
    return BatchTable(spark, f"{folder}/rows").read()


def late_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and late rows by batch, of all batches there ever were."""
    return BatchTable(spark, f"{folder}/counts", LATENESS).read()
