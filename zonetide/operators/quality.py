"""Row validation, profiling and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions.numeric import count_where, round_even, share
from zonetide.operators.quantiles import exact_quantiles

REASON = "failure_reason"


def failure_reasons(columns: list[str], required=S.REQUIRED_COLUMNS, ranges=S.RANGE_RULES) -> Column:
    """All failed checks of a row joined by '; ', empty when it is fine."""
    checks = [F.when(F.col(c).isNull(), f"null_{c}") for c in required if c in columns]
    for c, (low, high) in ranges.items():
        if c in columns:
            v = F.col(c)
            checks.append(F.when((v < low) | (v > high), F.format_string(f"{c}_out_of_range(%.2f)", v.cast("double"))))

    def bad(name: str, broken: Column) -> None:
        if name in columns:
            checks.append(F.when(F.col(name).isNotNull() & broken,
                                 F.concat(F.lit(f"invalid_{name}("), F.col(name).cast("string"), F.lit(")"))))

    bad("weather_code", ~F.col("weather_code").isin(*S.VALID_WEATHER_CODES))
    bad("zone_id", F.col("zone_id") < 1)
    bad("region", ~F.col("region").isin(*S.VALID_REGIONS))
    bad("zone_type", ~F.col("zone_type").isin(*S.ZONE_TYPE_CODES))
    return F.concat_ws("; ", *checks)


def missing_columns(df: DataFrame, required) -> list[str]:
    return [c for c in required if c not in df.columns]


def schema_gate(df: DataFrame, required, wording: str = "missing columns") -> tuple[DataFrame, DataFrame]:
    """Every row fails when a required column is absent; else every row passes."""
    gone = missing_columns(df, required)
    if not gone:
        return df, df.limit(0).withColumn(REASON, F.lit(None).cast("string"))
    return df.limit(0), df.withColumn(REASON, F.lit(f"{wording}: {gone}"))


def tagged(df: DataFrame, required=S.REQUIRED_COLUMNS, ranges=S.RANGE_RULES) -> DataFrame:
    """Rows with their failure reasons (empty text when fine): one scan serves both outcomes."""
    gone = missing_columns(df, required)
    if gone:
        return df.withColumn(REASON, F.lit(f"missing columns: {gone}"))
    return df.withColumn(REASON, failure_reasons(df.columns, required, ranges))


def validate(df: DataFrame, required=S.REQUIRED_COLUMNS, ranges=S.RANGE_RULES) -> tuple[DataFrame, DataFrame]:
    """(clean rows, failed rows with a reason)."""
    t = tagged(df, required, ranges)
    return t.filter(F.col(REASON) == "").drop(REASON), t.filter(F.col(REASON) != "")


def reason_counts(failed: DataFrame) -> DataFrame:
    """How often each kind of failure occurs; values in brackets are cut off."""
    each = failed.select(F.explode(F.split(REASON, "; ")).alias("reason"))
    return each.withColumn("reason", F.regexp_replace("reason", r"\(.*\)$", "")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def null_cells(df: DataFrame, columns) -> DataFrame:
    """Total null cells over the given columns, one row."""
    total = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("feature_nan_count"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls, null share, distinct values, mean, deviation and range per numeric column.

    One pass: columns are turned into rows before the aggregation, so distinct counting is keyed
    by (column, value) and spread over all tasks.
    """
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "v")
    counts = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("v"), F.col("n")
    mean = F.sum(v * n) / F.sum(F.when(v.isNotNull(), n))
    out = counts.groupBy("column_name").agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("nulls"),
        F.count(v).alias("distinct_values"),
        round_even(mean).alias("mean_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"))
    return out.withColumn("null_share", share("nulls", "total_rows"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, range and exact quartiles of one column."""
    names = ("p25", "p50", "p75")
    # Two scans for all three.
    quartiles = exact_quantiles(df, column, dict(zip(names, (0.25, 0.5, 0.75)))).select(F.struct(*names)).scalar()
    c = F.col(column).cast("double")
    stats = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean_value"), F.stddev_samp(c).alias("std_value"),
                   F.min(c).alias("min_value"), F.max(c).alias("max_value"))
    return stats.withColumn("_q", quartiles).select("*", "_q.*").drop("_q")


def duplicates_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first per key, one row. Keys are counted first, never listed in one place."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys"),
                       F.sum(F.col("n") - 1).alias("duplicate_rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def label_rate(df: DataFrame, group: str, label: str) -> DataFrame:
    """Share of positives per group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), round_even(F.avg(label)).alias("label_rate"))


def mean_by_label(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return df.groupBy(label).agg(*[round_even(F.avg(c)).alias(f"mean_{c}") for c in columns])


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Counts, positive share and majority : minority ratio, one row."""
    pos, neg = count_where(F.col(label) == 1), count_where(F.col(label) == 0)
    counted = df.agg(pos.alias("positives"), neg.alias("negatives"))
    return counted.select(
        "positives", "negatives", share("positives", F.col("positives") + F.col("negatives")).alias("positive_share"),
        share(F.greatest("positives", "negatives"), F.least("positives", "negatives")).alias("imbalance_ratio"))


def correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Pearson correlation of each column with the target, as rows."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    long = one.unpivot([], columns, "feature", "correlation")
    return long.select("feature", round_even("correlation").alias("correlation"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs of a fixed column list in one pass, as rows."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "c")
    return long.select(F.split("pair", r"\|")[0].alias("feature_a"), F.split("pair", r"\|")[1].alias("feature_b"),
                       round_even("c").alias("correlation"))


def mutual_information(df: DataFrame, label: str, features: list[str], bins: int = 10) -> DataFrame:
    """Binned mutual information of each feature with the label (natural log).

    Bins are cut at exact quantiles of each feature, so they hold about equally many rows; one grouped contingency table for all
    features. Equal values share a bin.
    """
    long = (df.select(F.col(label).alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
            .unpivot(["y"], features, "feature", "v").filter("v is not null and y is not null"))
    names = {f"_q{i}": i / bins for i in range(1, bins)}
    cuts = exact_quantiles(long, "v", names, ["feature"])
    cell = (long.join(cuts, "feature").withColumn("bin", sum(((F.col("v") > F.col(q)).cast("int") for q in names), F.lit(0)))
            .groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n")))
    by_bin = cell.groupBy("feature", "bin").agg(F.sum("n").alias("nx"))
    by_label = cell.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = cell.groupBy("feature").agg(F.sum("n").alias("nt"))
    joined = cell.join(by_bin, ["feature", "bin"]).join(by_label, ["feature", "y"]).join(total, "feature")
    n, nx, ny, nt = (F.col(c).cast("double") for c in ("n", "nx", "ny", "nt"))
    return joined.groupBy("feature").agg(round_even(F.sum(n / nt * F.log(n * nt / (nx * ny)))).alias("mutual_information"))


def coverage(df: DataFrame, lag_columns: list[str], ts: str = "timestamp", min_hours: int = 24) -> DataFrame:
    """Span, distinct hours and zones, lag coverage, and whether the set is long enough to train on."""
    hours = df.select(F.date_trunc("hour", ts).alias("h")).distinct().agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b"))
    zones = df.select("zone_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    span = F.timestamp_diff("HOUR", F.col("a"), F.col("b"))
    lags = df.agg(*[round_even(F.avg(F.col(c).isNotNull().cast("double"))).alias(f"{c}_coverage")
                    for c in lag_columns])
    one = hours.select(F.col("n").alias("distinct_hours"), zones.scalar().alias("distinct_zones"),
                       span.alias("span_hours"), (span >= min_hours).alias("ready"))
    return one.withColumn("_c", lags.select(F.struct(*[f"{c}_coverage" for c in lag_columns])).scalar()).select("*", "_c.*").drop("_c")


def leakage_audit(df: DataFrame) -> DataFrame:
    """Do lag and rolling columns look shifted? Shares of coincidence and pass flags, one row."""
    same = lambda a, b: F.avg((a == b).cast("double"))
    one = df.agg(round_even(same(F.col("taxi_lag_1h"), F.col("taxi_count"))).alias("lag_equals_current"),
                 round_even(same(F.rint("taxi_rolling_3h"), F.col("taxi_count"))).alias("rolling_equals_current"))
    return one.withColumns({"lag_ok": F.col("lag_equals_current") < 0.15,
                            "rolling_ok": F.col("rolling_equals_current") < 0.10})


def imputation_values(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Medians of numeric columns and modes of text columns as rows (column_name, number, label)."""
    found = []
    if numeric:  # all columns at once: two scans, whatever their number
        long = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "column_name", "v")
        found.append(exact_quantiles(long, "v", {"number": 0.5}, ["column_name"]).withColumn("label", F.lit(None).cast("string")))
    if text:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in text]).unpivot([], text, "column_name", "v").filter("v IS NOT NULL")
        counts = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
        found.append(counts.groupBy("column_name").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("label"))
                     .select("column_name", F.lit(None).cast("double").alias("number"), "label"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in [*numeric, *text]])).alias("column_name"))
    return names.join(reduce(DataFrame.unionByName, found), "column_name", "left")  # also columns without a value


def impute(df: DataFrame, train: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Fill nulls with values fitted on the training rows."""
    fitted = imputation_values(train, numeric, text)
    cols = {c: F.coalesce(F.col(c), fitted.filter(F.col("column_name") == c).select("number").scalar()) for c in numeric}
    cols |= {c: F.coalesce(F.col(c), fitted.filter(F.col("column_name") == c).select("label").scalar()) for c in text}
    return df.withColumns(cols)
