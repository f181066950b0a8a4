"""Ordered per-key computations on series too long for one task.

A zone-hour table has at most one row per zone and hour, so a zone's whole history is bounded
by the calendar (8,784 rows a year) and a plain window is right for it. Raw 5-minute or event
series have no such bound. For those all rows are cut into ranges of about equal number by key and time, so a key with most of
the rows is spread over many ranges; what one range hands on to the next is a row per key and range. Lags and frames
get copies of the few rows before and after a chunk that they can reach. Results are the same as with one window per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonetide.session import written

#: Rows of one range: what a task sorts. The number of ranges follows from the number of rows.
RANGE_ROWS = 250_000


def ranged(df: DataFrame, order: list[Column | str], rows: int = RANGE_ROWS) -> DataFrame:
    """The rows stored in ranges of ``order`` of about ``rows`` each, numbered in that order by ``_range``. Equal rows share a range."""
    stored = written(df, "rows")
    ranges = max(1, -(-stored.count() // rows))
    if ranges == 1:
        return stored.withColumn("_range", F.lit(0))
    # Stored with its number: cut anew after a lost task, the ranges could differ.
    return written(stored.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, keys: list[str], ts: str, tie: list[str] | None = None, out: str = "_pos", rows: int = RANGE_ROWS) -> DataFrame:
    """1-based row number per key: counts per range give each range its starting number."""
    order = [ts, *(tie or [])]
    cut = ranged(df, [*keys, *order], rows)
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_range").orderBy(*order)
    return (cut.withColumn("_rn", F.row_number().over(inside)).join(starts, [*keys, "_range"])
            .withColumn(out, F.col("_start") + F.col("_rn")).drop("_range", "_rn", "_start"))


def chunked(df: DataFrame, rows: int, back: int, ahead: int = 0, pos: str = "_pos") -> DataFrame:
    """Cut a numbered series into chunks of ``rows``; copy the ``back`` last rows of a chunk into
    the next one and the ``ahead`` first rows into the previous one. ``_own`` marks originals."""
    if rows < max(back, ahead):
        raise ValueError("a chunk must be at least as long as its reach")
    chunk = F.floor((F.col(pos) - 1) / F.lit(rows)).cast("long")
    offset = F.pmod(F.col(pos) - 1, F.lit(rows))
    homes = [F.struct(chunk.alias("_chunk"), F.lit(True).alias("_own")),
             F.when(offset >= rows - back, F.struct((chunk + 1).alias("_chunk"), F.lit(False).alias("_own")))]
    if ahead:
        homes.append(F.when((offset < ahead) & (chunk > 0),
                            F.struct((chunk - 1).alias("_chunk"), F.lit(False).alias("_own"))))
    return df.withColumn("_home", F.explode(F.array_compact(F.array(*homes)))).select(
        *df.columns, "_home._chunk", "_home._own")


def run_lengths(df: DataFrame, keys: list[str], ts: str, flag: str, tie: list[str] | None = None, rows: int = RANGE_ROWS,
                out: str = "run_length", fresh: str | None = None) -> DataFrame:
    """Consecutive true rows up to and including each row. Rows of one moment are ordered by ``tie``, then true ones first.

    Inside a range a run restarts at each false row. Only rows before the first false row of a range can continue a run from
    earlier ranges; what they add is the length of the run at its end, found from one summary row per key and range. ``fresh``
    names a column that tells rows which have no false row of their key before them.
    """
    tagged = df.withColumn("_hit", F.coalesce(F.col(flag).cast("int"), F.lit(0)))
    order = [F.col(c) for c in (ts, *(tie or []))] + [F.col("_hit").desc()]
    cut = ranged(tagged, [*[F.col(k) for k in keys], *order], rows)
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumns({"_island": F.sum(1 - F.col("_hit")).over(inside), "_rn": F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))})
    in_island = W.partitionBy(*keys, "_range", "_island").orderBy("_rn").rowsBetween(W.unboundedPreceding, 0)
    local = local.withColumn("_run", F.sum("_hit").over(in_island))
    summary = local.groupBy(*keys, "_range").agg(F.max_by("_run", "_rn").alias("_tail"), F.max("_island").alias("_falses"))
    # One row per key and range: a range without a false row passes the earlier run on.
    order = W.partitionBy(*keys).orderBy("_range")
    to_here = order.rowsBetween(W.unboundedPreceding, 0)
    blocks = summary.withColumn("_block", F.sum(F.when(F.col("_falses") > 0, 1).otherwise(0)).over(to_here))
    in_block = W.partitionBy(*keys, "_block").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)
    ends = blocks.withColumn("_end", F.sum("_tail").over(in_block))
    carried = ends.select(*keys, "_range", F.coalesce(F.lag("_end").over(order), F.lit(0)).alias("_carry"),
                          F.coalesce(F.lag("_block").over(order), F.lit(0)).alias("_resets"))
    open_ = F.col("_island") == 0
    found = local.join(carried, [*keys, "_range"]).withColumn(out, F.col("_run") + F.when(open_, F.col("_carry")).otherwise(0))
    if fresh:
        found = found.withColumn(fresh, open_ & (F.col("_resets") == 0))
    return found.drop("_range", "_rn", "_hit", "_island", "_run", "_carry", "_resets")
