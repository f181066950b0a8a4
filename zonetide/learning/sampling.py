"""Class weights, over- and under-sampling, synthetic minority rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.learning.neighbours import neighbours_of_spots, opposite_neighbours, vector
from zonetide.learning.splits import uniform
from zonetide.session import written


def _ratio(df: DataFrame, label: str) -> Column:
    """Negatives per positive, as a scalar subquery."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg((neg / F.greatest(pos, F.lit(1))).alias("r")).scalar()


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 * class size): both classes weigh the same in total."""
    n, pos = F.count(F.lit(1)), F.count_if(F.col(label) == 1)
    one = df.agg((n / (F.lit(2.0) * F.greatest(pos, F.lit(1)))).alias("p"), (n / (F.lit(2.0) * F.greatest(n - pos, F.lit(1)))).alias("q"))
    both = one.select(F.struct("p", "q")).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, both["p"]).otherwise(both["q"]))


def oversample(df: DataFrame, label: str, keys: list[str], seed: int = 0) -> DataFrame:
    """Repeat positives until the classes balance: whole copies plus one more by draw."""
    copies = F.when(F.col(label) == 1, F.greatest(F.floor(_ratio(df, label) + uniform(*keys, seed=seed)), F.lit(1))).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))


def undersample(df: DataFrame, label: str, keys: list[str], seed: int = 0) -> DataFrame:
    """Keep every positive and as large a share of negatives, by draw. Dropping rows is the purpose here."""
    return df.filter((F.col(label) == 1) | (uniform(*keys, seed=seed) < F.lit(1.0) / _ratio(df, label)))


def smote(df: DataFrame, label: str, key: str, columns: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """All rows plus synthetic positives between a positive and one of its k nearest positives.

    Returns (key, label, columns..., copy, synthetic); ``copy`` numbers the rows made from one row, 0 for the row itself. Each
    positive makes as many rows as balance needs; neighbour and position are drawn from the row's key, so a rerun makes the same rows.
    """
    base = df.select(key, label, *[F.col(c).cast("double").alias(c) for c in columns])
    minority = base.filter(F.col(label) == 1).select(key, label, vector(columns).alias("v"))
    distinct = minority.groupBy("v").agg(F.min(key).alias("_rep"))
    near = neighbours_of_spots(distinct.select(F.col("_rep").alias(key), "v"), key, k)
    spot = distinct.select(F.col("_rep").alias("neighbour"), "v")
    # At most k entries per positive spot.
    options = near.join(spot, "neighbour").groupBy(F.col(key).alias("_rep")).agg(
        F.array_sort(F.collect_list(F.struct("place", "v"))).alias("_options"))
    extra = F.floor(_ratio(base, label) - F.lit(1.0) + uniform(key, seed=seed)).cast("int")
    made = (minority.join(distinct, "v").join(options, "_rep").withColumn("_extra", extra).filter(F.col("_extra") > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_extra")))))
    pick = F.floor(uniform(key, "copy", seed=seed + 1) * F.size("_options")).cast("int")
    drawn = made.withColumns({"_o": F.get("_options", pick)["v"], "_t": uniform(key, "copy", seed=seed + 2)})
    between = [(F.col("v")[i] + F.col("_t") * (F.col("_o")[i] - F.col("v")[i])).alias(c) for i, c in enumerate(columns)]
    new = drawn.select(key, label, *between, "copy", F.lit(True).alias("synthetic"))
    return base.withColumns({"copy": F.lit(0), "synthetic": F.lit(False)}).unionByName(new)


def tomek_links(df: DataFrame, label: str, key: str, columns: list[str], kin: str | None = None) -> DataFrame:
    """Pairs of opposite class that are each other's nearest row: (key, neighbour).

    Rows of one class at the same spot have each other as nearest and so belong to no pair. ``kin`` names a column whose equal values
    tell rows that are likely to be near each other; it saves work and changes no pair.
    """
    spots = written(df.groupBy(label, vector(columns).alias("v")).agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("_m"), (F.min(kin) if kin else F.lit(None).cast("string")).alias("kin")), "classes")
    side = F.when(F.col("_m") == 1, F.col(label).cast("string")).alias("side")
    near = opposite_neighbours(spots.select(key, "v", side, "kin"), key)
    single = spots.filter(F.col("_m") == 1).select(key, label)
    a = near.join(single, key)
    other = single.select(F.col(key).alias("neighbour"), F.col(label).alias("_other"))
    back = near.select(F.col(key).alias("neighbour"), F.col("neighbour").alias(key))
    return (a.join(other, "neighbour").filter(F.col(label) != F.col("_other")).join(back, [key, "neighbour"], "left_semi")
            .select(key, "neighbour"))


def without_tomek_links(df: DataFrame, label: str, key: str, columns: list[str], kin: str | None = None) -> DataFrame:
    """Drop both ends of every pair."""
    links = tomek_links(df, label, key, columns, kin).select(key)
    return df.join(links, key, "left_anti")


def smote_tomek(df: DataFrame, label: str, key: str, columns: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Synthetic positives, then without the pairs of opposite class that are each other's nearest row, made rows included."""
    made = written(smote(df, label, key, columns, k, seed), "smote").withColumn("_row", F.concat_ws("#", key, "copy"))
    # Made rows lie on lines from the row that they are made from.
    kin = made.withColumn("_kin", F.when(F.col(label) == 1, F.col(key)))
    return without_tomek_links(kin, label, "_row", columns, "_kin").drop("_row", "_kin")
