"""Exact quantiles and running totals that do not need one task to see every value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonetide.operators.segments import RANGE_ROWS, ranged
from zonetide.session import written

#: Size of the sketch, and how far on either side of a wanted share of the values the second scan keeps them. A sketch of this
#: size is off by less than half as much nearly always; when it is not, the search goes on with a wider band.
SKETCH = 2048
BAND = 0.005


def running_totals(df: DataFrame, order: str, sums: dict[str, str], descending: bool = True,
                   groups: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Cumulative sums over an order within groups.

    ``df`` holds one row per (group, order) value. The rows are stored in ranges of that order of about ``range_rows`` each. One
    pass sums up every range, and a row's total is that of the ranges before plus the running total inside its own.
    """
    groups = groups or []
    direction = F.col(order).desc() if descending else F.col(order).asc()
    cut = ranged(df, [*groups, direction], range_rows)
    totals = cut.groupBy(*groups, "_range").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = totals.select(*[F.col(c).alias(f"_g_{c}") for c in groups], F.col("_range").alias("_before"), *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_b_{out}") for out in sums])
    inside = W.partitionBy(*groups, "_range").orderBy(direction).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumns({f"_l_{out}": F.sum(c).over(inside) for out, c in sums.items()})
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in groups] + [F.col("_range") == F.col("_before")]
    joined = local.join(offsets, reduce(Column.__and__, same))
    return joined.select(*df.columns, *[(F.col(f"_l_{out}") + F.col(f"_b_{out}")).alias(out) for out in sums])


def counted_quantiles(df: DataFrame, value: str, probs: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles of values of a small domain (hours, counts, whole minutes), which are counted first.

    One row per group, one column per entry of ``probs``. The distinct values of a group meet in one task.
    """
    groups = groups or []
    counts = (df.select(*groups, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
              .groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy(*groups).agg(*[F.percentile("v", float(p), F.col("n")).alias(name) for name, p in probs.items()])


def _cells(rows: DataFrame, probs: list[float], groups: list[str], band: float | None, sketch: int) -> DataFrame:
    """The values near the wanted ranks with their counts, and one row for each gap between these bands.

    ``v``: the value, or the greatest one of a gap; ``exact`` is null for gaps. Without ``band`` every value is kept.
    """
    if band is None:
        return rows.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("n")).withColumn("exact", F.col("v"))
    drawn = rows.groupBy(*groups).agg(F.kll_sketch_agg_double("v", sketch).alias("s"))
    at = lambda shares: F.when(F.kll_sketch_get_n_double("s") > 0, F.kll_sketch_get_quantile_double(
        "s", F.array(*[F.lit(min(max(x, 0.0), 1.0)) for x in shares])))
    bands = drawn.select(*groups, F.struct(at([p - band for p in probs]).alias("low"), at([p + band for p in probs]).alias("high")).alias("_b"))
    tagged = rows.join(bands, groups) if groups else rows.withColumn("_b", bands.select("_b").scalar())
    low, high = ([F.get(f"_b.{side}", F.lit(i)) for i in range(len(probs))] for side in ("low", "high"))
    passed = sum(((F.col("v") >= x).cast("int") for x in low), F.lit(0))
    near = reduce(Column.__or__, [F.col("v").between(a, b) for a, b in zip(low, high)])
    # Between two bands the number of bands passed tells the gap; its values lie behind those of the bands passed.
    return (tagged.select(*groups, "v", F.coalesce(passed, F.lit(-1)).alias("_gap"), F.when(near, F.col("v")).alias("exact"))
            .groupBy(*groups, "_gap", "exact").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v")).drop("_gap"))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], groups: list[str] | None = None,
                    band: float = BAND, sketch: int = SKETCH) -> DataFrame:
    """Linear-interpolated quantiles, one row per group, one column per entry of ``probs``.

    Two scans: the first draws a sketch of each group, the second counts the values between two of its quantiles around every
    wanted rank, and how many lie in the gaps. The value at the rank is then read off running totals. If a rank falls into
    a gap, because the sketch was too far off, the band is widened, in the end to all values, so the result is always exact.
    """
    groups = groups or []
    rows = df.select(*groups, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())

    def rank(p: float, up: bool) -> Column:
        at = (F.col("total") - 1) * F.lit(float(p))
        return (F.ceil(at) if up else F.floor(at)).cast("long")

    sides = [(name, p, up) for name, p in probs.items() for up in (False, True)]
    for width in (band, 20 * band, None):
        ends = running_totals(_cells(rows, list(probs.values()), groups, width, sketch), "v", {"end": "n"}, descending=False, groups=groups)
        whole = ends.groupBy(*groups).agg(F.sum("n").alias("total"))
        known = ends.join(whole, groups) if groups else ends.withColumn("total", whole.scalar())
        here = lambda r: F.max(F.when((r >= F.col("end") - F.col("n")) & (r < F.col("end")), F.col("exact")))
        picked = written(known.groupBy(*groups).agg(F.max("total").alias("total"), *[
            here(rank(p, up)).alias(f"{name}_{up}") for name, p, up in sides]), "quantiles")
        missed = reduce(Column.__or__, [F.col(f"{name}_{up}").isNull() for name, _, up in sides])
        if picked.filter(F.col("total").isNotNull() & missed).isEmpty():
            break

    def between(name: str, p: float) -> Column:
        at = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"{name}_False"), F.col(f"{name}_True")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)

    return picked.select(*groups, *[between(n, p) for n, p in probs.items()])
