"""Classifier quality from (label, score) rows.

Counts per distinct score are the only thing kept; curves are running totals over those,
computed in bins so that no single task sorts all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.functions.numeric import count_where, round_even
from zonetide.operators.quantiles import running_totals

SWEEP = tuple(round(0.10 + 0.05 * i, 2) for i in range(13))


def score_counts(df: DataFrame, label: str = "y", score: str = "p", groups: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*(groups or []), F.col(score).alias("s")).agg(
        count_where(F.col(label) == 1).alias("pos"), count_where(F.col(label) == 0).alias("neg"))


def curve(df: DataFrame, label: str = "y", score: str = "p", groups: list[str] | None = None) -> DataFrame:
    """True and false positives at every distinct threshold, with totals."""
    groups = groups or []
    counts = score_counts(df, label, score, groups)
    run = running_totals(counts, "s", {"tp": "pos", "fp": "neg"}, groups=groups)
    totals = counts.groupBy(*groups).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if groups:
        return run.join(totals, groups)
    return run.withColumn("_t", totals.select(F.struct("all_pos", "all_neg")).scalar()).select("*", "_t.*").drop("_t")


def _f1(tp: Column, fp: Column, pos: Column) -> Column:
    """2PR/(P+R) from counts; 0 without true positives."""
    return F.when(tp > 0, F.lit(2.0) * tp / (tp + fp + pos)).otherwise(F.lit(0.0))


def ranking_quality(df: DataFrame, label: str = "y", score: str = "p", groups: list[str] | None = None) -> DataFrame:
    """ROC AUC, average precision, best F1 and its threshold (the lowest among equals)."""
    groups = groups or []
    c = curve(df, label, score, groups)
    tp, fp, pos, neg = (F.col(x).cast("double") for x in ("tp", "fp", "all_pos", "all_neg"))
    # Pairs ranked right: a negative is beaten by the positives above it, ties count half.
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    step = F.sum(F.col("pos") / F.nullif(pos, F.lit(0.0)) * (tp / (tp + fp)))  # null without positives
    best = F.max(F.struct(_f1(tp, fp, pos).alias("f1"), (-F.col("s")).alias("minus")))
    one = c.groupBy(*groups).agg(
        (won / F.nullif(F.max(pos) * F.max(neg), F.lit(0.0))).alias("auc"), step.alias("ap"), best.alias("b"),
        F.max_by(F.col("tp"), F.struct(_f1(tp, fp, pos), -F.col("s"))).alias("tp"),
        F.max_by(F.col("fp"), F.struct(_f1(tp, fp, pos), -F.col("s"))).alias("fp"),
        F.max("all_pos").alias("pos"), F.max("all_neg").alias("neg"))
    t = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    return one.select(
        *groups, round_even("auc").alias("roc_auc"), round_even("ap").alias("average_precision"),
        (-F.col("b.minus")).alias("threshold"), round_even(t).alias("precision"),
        round_even(F.col("tp") / F.nullif(F.col("pos"), F.lit(0))).alias("recall"), round_even("b.f1").alias("f1"),
        F.col("tp").alias("tp"), F.col("fp").alias("fp"), (F.col("pos") - F.col("tp")).alias("fn"),
        (F.col("neg") - F.col("fp")).alias("tn"))


def evaluate(df: DataFrame, label: str = "y", score: str = "p", groups: list[str] | None = None) -> DataFrame:
    """The full report: ranking quality at the best threshold plus error and spread of the scores."""
    groups = groups or []
    y, p = F.col(label).cast("double"), F.col(score)
    spread = df.groupBy(*groups).agg(
        round_even(F.avg(F.abs(p - y))).alias("mae"), round_even(F.sqrt(F.avg((p - y) * (p - y)))).alias("rmse"),
        round_even(F.avg(p)).alias("pred_mean"), round_even(F.stddev_pop(p)).alias("pred_std"),
        F.count(F.lit(1)).alias("n_test"), round_even(F.avg(y)).alias("positive_rate"))
    ranked = ranking_quality(df, label, score, groups)
    if groups:
        joined = ranked.join(spread, groups)
    else:
        joined = ranked.withColumn("_s", spread.select(F.struct(*spread.columns)).scalar()).select("*", "_s.*").drop("_s")
    return joined.withColumn("pct_above_threshold", round_even((F.col("tp") + F.col("fp")) / F.col("n_test"))) \
        .withColumn("best_threshold", round_even("threshold")).drop("threshold")


def threshold_sweep(df: DataFrame, label: str = "y", score: str = "p", thresholds=SWEEP) -> DataFrame:
    """Precision, recall, F1 and counts at fixed thresholds: one conditional aggregation, no row copies."""
    y, p = F.col(label), F.col(score)
    aggs = [F.struct(F.lit(float(t)).alias("threshold"), count_where((p >= t) & (y == 1)).alias("tp"),
                     count_where((p >= t) & (y == 0)).alias("fp"), count_where((p < t) & (y == 1)).alias("fn")) for t in thresholds]
    long = df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: round_even(F.when(b > 0, a / b).otherwise(F.lit(0.0)))
    return long.select("threshold", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                       ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"), fn.alias("missed"),
                       fp.alias("false_alarms"), (tp + fp).alias("predicted_positives"))


def calibration(df: DataFrame, label: str = "y", score: str = "p", bins: int = 10) -> DataFrame:
    """Mean score and positive share per right-closed bin; empty bins are absent."""
    at = F.least(F.greatest(F.lit(1), F.ceil(F.col(score) * F.lit(float(bins)))), F.lit(bins)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), round_even(F.avg(score)).alias("mean_predicted"),
                                           round_even(F.avg(F.col(label).cast("double"))).alias("fraction_positive"))


def brier(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    gap = F.col(score) - F.col(label).cast("double")
    return df.agg(round_even(F.avg(gap * gap)).alias("brier_score"))


def with_error_type(df: DataFrame, label: str = "y", score: str = "p", threshold: float = 0.5) -> DataFrame:
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    kind = F.when(y & hit, "TP").when(~y & hit, "FP").when(y & ~hit, "FN").otherwise("TN")
    return df.withColumn("error_type", kind)


def error_breakdown(df: DataFrame) -> DataFrame:
    """Rows per error type with miss and false-alarm rates, one row. Needs ``error_type``."""
    e = F.col("error_type")
    c = df.agg(*[count_where(e == k).alias(k.lower()) for k in ("TP", "FP", "FN", "TN")])
    rate = lambda a, b: round_even(F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1)))
    return c.select("*", rate("fn", "tp").alias("miss_rate"), rate("fp", "tn").alias("false_alarm_rate"))


def _error_rates(label: str, score: str) -> list[Column]:
    e, y = F.col("error_type"), F.col(label)
    miss, alarm, pos, neg = (count_where(c) for c in (e == "FN", e == "FP", y == 1, y == 0))
    return [F.count(F.lit(1)).alias("n"), pos.alias("positives"), count_where(e == "TP").alias("caught"),
            miss.alias("missed"), alarm.alias("false_alarms"),
            round_even(miss / F.greatest(pos, F.lit(1))).alias("fn_rate"),
            round_even(alarm / F.greatest(neg, F.lit(1))).alias("fp_rate"),
            round_even(F.avg(y.cast("double"))).alias("base_rate"),
            round_even(F.avg(F.when(e == "FN", F.col(score)))).alias("avg_prob_fn")]


def error_by_groups(df: DataFrame, columns: list[str], label: str = "y", score: str = "p") -> DataFrame:
    """Error rates for every value of every given column in one pass (grouping sets)."""
    keyed = df.withColumns({c: F.col(c).cast("string") for c in columns})
    stats = keyed.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().alias("gid"), *_error_rates(label, score))
    # grouping_id has one bit per column, 0 where the column is the grouped one.
    full, name, value = (1 << len(columns)) - 1, None, None
    for i, c in enumerate(columns):
        here = F.col("gid") == (full ^ (1 << (len(columns) - 1 - i)))
        name = F.when(here, c) if name is None else name.when(here, c)
        value = F.when(here, F.col(c)) if value is None else value.when(here, F.col(c))
    return stats.select(name.alias("dimension"), F.coalesce(value, F.lit("")).alias("member"), "n", "positives", "caught", "missed",
                        "false_alarms", "fn_rate", "fp_rate", "base_rate", "avg_prob_fn")


def hardest_groups(stats: DataFrame, n: int = 15, at_least: int = 5, easiest: bool = False) -> DataFrame:
    """Groups with the highest (or lowest) miss rate among those with enough positives."""
    rate = F.col("fn_rate").asc() if easiest else F.col("fn_rate").desc()
    return stats.filter(F.col("positives") >= at_least).orderBy(rate, "dimension", "member").limit(n)


def missed_vs_caught(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature means of caught and missed positives, their difference and whether it exceeds 10 %."""
    long = (df.filter(F.col("error_type").isin("TP", "FN"))
            .select("error_type", *[F.col(f).cast("double").alias(f) for f in features])
            .unpivot(["error_type"], features, "feature", "v"))
    m = long.groupBy("feature").agg(F.avg(F.when(F.col("error_type") == "TP", F.col("v"))).alias("t"),
                                    F.avg(F.when(F.col("error_type") == "FN", F.col("v"))).alias("f"))
    gap = F.col("f") - F.col("t")
    return m.select("feature", round_even("t").alias("tp_mean"), round_even("f").alias("fn_mean"), round_even(gap).alias("difference"),
                    (F.abs(gap) > F.lit(0.1) * F.abs(F.col("t") + F.lit(1e-9))).alias("marked"))


def best_row(df: DataFrame, metric: str, ties: list[str]) -> DataFrame:
    return df.orderBy(F.col(metric).desc(), *ties).limit(1)
