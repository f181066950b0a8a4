"""Holdouts, strata and folds that give the same rows on every run and every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonetide.operators.quantiles import counted_quantiles, exact_quantiles


def uniform(*keys: str, seed: int = 0) -> Column:
    """A number in [0, 1) from the row's keys: repeatable, so lost tasks redo the same draw."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def time_split(df: DataFrame, ts: str = "timestamp", holdout: float = 0.2, out: str = "is_train") -> DataFrame:
    """The newest share of the rows, by time, is the holdout. Whole hours stay together."""
    hour = F.floor(F.unix_timestamp(F.col(ts)) / F.lit(3600))
    marked = df.withColumn("_hour", hour)
    # One value per hour of the calendar: a narrow domain.
    cut = counted_quantiles(marked, "_hour", {"cut": 1.0 - holdout}).select("cut").scalar()
    return marked.withColumn(out, F.col("_hour") <= cut).drop("_hour")


def positional_split(df: DataFrame, zone: str = "zone_id", ts: str = "timestamp", holdout: float = 0.2,
                     out: str = "is_train") -> DataFrame:
    """The last share of the rows in (zone, time) order is the holdout.

    Positions come from one count per zone and a numbering inside each zone; rows are never
    brought into one global order.
    """
    sizes = df.groupBy(zone).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy(zone).rowsBetween(W.unboundedPreceding, -1)  # one row per zone
    starts = sizes.select(zone, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    total = df.agg(F.count(F.lit(1))).scalar()
    placed = df.withColumn("_rn", F.row_number().over(W.partitionBy(zone).orderBy(ts))).join(starts, zone)
    train_rows = total - F.ceil(total * F.lit(holdout))
    return placed.withColumn(out, F.col("_start") + F.col("_rn") <= train_rows).drop("_rn", "_start")


def stratified_split(df: DataFrame, label: str, keys: list[str], holdout: float = 0.2, seed: int = 0,
                     out: str = "is_train") -> DataFrame:
    """The same share of every class goes to the holdout."""
    drawn = df.withColumn("_u", uniform(*keys, seed=seed))
    cuts = exact_quantiles(drawn, "_u", {"_cut": holdout}, [label])
    return drawn.join(cuts, label).withColumn(out, F.col("_u") >= F.col("_cut")).drop("_u", "_cut")


def stratified_folds(df: DataFrame, label: str, keys: list[str], k: int = 5, seed: int = 0, out: str = "fold") -> DataFrame:
    """Folds of equal size within every class."""
    drawn = df.withColumn("_u", uniform(*keys, seed=seed))
    names = {f"_c{i}": i / k for i in range(1, k)}
    cuts = exact_quantiles(drawn, "_u", names, [label])
    above = sum(((F.col("_u") >= F.col(n)).cast("int") for n in names), F.lit(0))
    return drawn.join(cuts, label).withColumn(out, above).drop("_u", *names)
