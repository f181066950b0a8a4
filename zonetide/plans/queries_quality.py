"""Validation, profiling and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.operators import features as FT
from zonetide.operators import quality as QL
from zonetide.plans import proxies as P
from zonetide.plans import sql as Q
from zonetide.plans.catalogue import query
from zonetide.session import use_utc
from zonetide.sources.readers import table


def rows_to_check(spark, folder):
    """Line items as zone rows, with every kind of fault in some of them."""
    li = table(use_utc(spark), folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        (F.col("l_linenumber") - 1).alias("zone_id"), F.col("l_shipdate").alias("timestamp"),
        F.when(F.col("l_quantity") != 7, F.col("l_quantity") * 150).alias("taxi_count"),
        (F.col("l_discount") * 4000).alias("rainfall_mm"),
        (F.col("l_suppkey") % 100).cast("int").alias("weather_code"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("is_holiday"),
        F.when(F.col("l_tax") < 0.07, "Central").otherwise("Nowhere").alias("region"),
        F.when(F.col("l_linestatus") == "F", "CBD").otherwise("port").alias("zone_type"))


RAW = """chk AS (SELECT l_orderkey AS row_id, l_linenumber AS line, l_partkey AS part, l_linenumber - 1 AS zone_id, l_shipdate AS timestamp,
   CASE WHEN l_quantity <> 7 THEN l_quantity * 150 END AS taxi_count, l_discount * 4000 AS rainfall_mm, CAST(l_suppkey % 100 AS INTEGER) AS weather_code,
   CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END AS is_holiday, CASE WHEN l_tax < 0.07::DOUBLE THEN 'Central' ELSE 'Nowhere' END AS region,
   CASE WHEN l_linestatus = 'F' THEN 'CBD' ELSE 'port' END AS zone_type FROM lineitem)"""
_CODES = Q.listed(S.VALID_WEATHER_CODES)
TAGGED = f"""tagged AS (SELECT *, concat_ws('; ', CASE WHEN taxi_count IS NULL THEN 'null_taxi_count' END, CASE WHEN is_holiday IS NULL THEN 'null_is_holiday' END,
   CASE WHEN taxi_count < 0 OR taxi_count > 5000 THEN 'taxi_count_out_of_range(' || printf('%.2f', taxi_count) || ')' END,
   CASE WHEN rainfall_mm < 0 OR rainfall_mm > 300 THEN 'rainfall_mm_out_of_range(' || printf('%.2f', rainfall_mm) || ')' END,
   CASE WHEN weather_code NOT IN ({_CODES}) THEN 'invalid_weather_code(' || CAST(weather_code AS VARCHAR) || ')' END,
   CASE WHEN zone_id < 1 THEN 'invalid_zone_id(' || CAST(zone_id AS VARCHAR) || ')' END,
   CASE WHEN region NOT IN ({Q.listed(S.VALID_REGIONS)}) THEN 'invalid_region(' || region || ')' END,
   CASE WHEN zone_type NOT IN ({Q.listed(S.ZONE_TYPE_CODES)}) THEN 'invalid_zone_type(' || zone_type || ')' END) AS failure_reason FROM chk)"""


@query("P-02 U-04", Q.with_(RAW, TAGGED) + "SELECT row_id, line, part, zone_id, taxi_count, weather_code FROM tagged WHERE failure_reason = ''")
def validate_clean(spark, folder):
    clean, _ = QL.validate(rows_to_check(spark, folder))
    return clean.select("row_id", "line", "part", "zone_id", "taxi_count", "weather_code")


@query("P-02 S-14", Q.with_(RAW, TAGGED) + "SELECT row_id, line, part, failure_reason FROM tagged WHERE failure_reason <> ''")
def validate_failed(spark, folder):
    _, failed = QL.validate(rows_to_check(spark, folder))
    return failed.select("row_id", "line", "part", "failure_reason")


@query("P-02", Q.with_(RAW, TAGGED) + r"""SELECT reason, CAST(count(*) AS BIGINT) AS rows FROM (SELECT regexp_replace(unnest(string_split(failure_reason, '; ')),
  '\(.*\)$', '') AS reason FROM tagged WHERE failure_reason <> '') GROUP BY 1""")
def reason_counts(spark, folder):
    _, failed = QL.validate(rows_to_check(spark, folder))
    return QL.reason_counts(failed)


@query("P-03", """SELECT failure_reason, CAST(count(*) AS BIGINT) AS rows FROM (SELECT 'missing columns: [''is_holiday'']' AS failure_reason FROM lineitem) GROUP BY 1""")
def schema_gate_failures(spark, folder):
    rows = rows_to_check(spark, folder).drop("is_holiday")
    _, failed = QL.schema_gate(rows, S.REQUIRED_COLUMNS)
    return failed.groupBy("failure_reason").agg(F.count(F.lit(1)).alias("rows"))


_LAGGED = ("l1", "l24", "l168")


@query("P-04", Q.with_(Q.COUNTS, Q.series("zc")) + """SELECT CAST(count(*) FILTER (WHERE l1 IS NULL) + count(*) FILTER (WHERE l24 IS NULL)
  + count(*) FILTER (WHERE l168 IS NULL) + count(*) FILTER (WHERE s6 IS NULL) AS BIGINT) AS feature_nan_count FROM raw_series""")
def feature_null_cells(spark, folder):
    from pyspark.sql import Window as W

    w = W.partitionBy("zone_id").orderBy("timestamp")
    raw = P.zone_counts(spark, folder).withColumns({
        "l1": F.lag("taxi_count", 1).over(w), "l24": F.lag("taxi_count", 24).over(w), "l168": F.lag("taxi_count", 168).over(w),
        "s6": F.stddev_samp("taxi_count").over(w.rowsBetween(-6, -1))})
    return QL.null_cells(raw, [*_LAGGED, "s6"])


_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("A-34", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS total_rows, {Q.count_if(f'{c} IS NULL')} AS nulls,
  CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values, {Q.r(f'CAST(sum(CAST({c} AS DECIMAL(18,6))) AS DOUBLE) / count({c})')} AS mean_value,
  min({c}) AS min_value, max({c}) AS max_value, 0.0::DOUBLE AS null_share FROM lineitem""" for c in _PROFILED))
def profile_nulls(spark, folder):
    return QL.profile(table(spark, folder, "lineitem"), list(_PROFILED))


@query("A-34", f"""SELECT CAST(count(l_extendedprice) AS BIGINT) AS n, {Q.r('avg(l_extendedprice)', 2)} AS mean_value, {Q.r('stddev_samp(l_extendedprice)', 2)} AS std_value,
  min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value, {Q.r('quantile_cont(l_extendedprice, 0.25)')} AS p25,
  {Q.r('quantile_cont(l_extendedprice, 0.5)')} AS p50, {Q.r('quantile_cont(l_extendedprice, 0.75)')} AS p75 FROM lineitem""")
def describe_column(spark, folder):
    d = QL.describe(table(spark, folder, "lineitem"), "l_extendedprice")
    return FT.rounded(FT.rounded(d, ["p25", "p50", "p75"]), ["mean_value", "std_value"], 2)


@query("A-34", """SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS distinct_keys,
  CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS duplicate_rows FROM lineitem""")
def duplicates_on_key(spark, folder):
    return QL.duplicates_on(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("A-34", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def value_counts(spark, folder):
    return QL.value_counts(table(spark, folder, "events"), "event_type")


@query("A-35", Q.with_(Q.LABELLED) + f"SELECT source, CAST(count(*) AS BIGINT) AS n, {Q.r('avg(y)')} AS label_rate FROM lab GROUP BY 1")
def label_rate_by_group(spark, folder):
    return QL.label_rate(P.labelled(spark, folder), "source", "y")


@query("A-35", Q.with_(Q.LABELLED) + f"SELECT y, {Q.r('avg(n_chars)')} AS mean_n_chars, {Q.r('avg(toxic)')} AS mean_toxic FROM lab GROUP BY 1")
def feature_mean_by_label(spark, folder):
    return QL.mean_by_label(P.labelled(spark, folder), "y", ["n_chars", "toxic"])


@query("A-37 Q-13", f"""SELECT positives, negatives, {Q.r('positives / (positives + negatives)')} AS positive_share,
  {Q.r('greatest(positives, negatives) / least(positives, negatives)')} AS imbalance_ratio
  FROM (SELECT {Q.count_if('quality = 1')} AS positives, {Q.count_if('quality = 0')} AS negatives FROM labels)""")
def class_balance(spark, folder):
    return QL.class_balance(table(spark, folder, "labels"), "quality")


_CORR = ("l_extendedprice", "l_discount", "l_tax")


@query("A-36", " UNION ALL ".join(f"SELECT '{c}' AS feature, {Q.r(f'corr({c}, l_quantity)')} AS correlation FROM lineitem" for c in _CORR))
def correlations(spark, folder):
    return QL.correlations(table(spark, folder, "lineitem"), "l_quantity", list(_CORR))


@query("A-36", " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {Q.r(f'corr({a}, {b})')} AS correlation FROM lineitem"
                                  for a in _CORR for b in _CORR))
def correlation_matrix(spark, folder):
    return QL.correlation_matrix(table(spark, folder, "lineitem"), list(_CORR))


@query("A-38", Q.with_(Q.LABELLED) + f"""SELECT feature, {Q.r('sum(n / nt * ln(n * nt / (nx * ny)))')} AS mutual_information FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY feature, bin) AS DOUBLE) AS nx, CAST(sum(n) OVER (PARTITION BY feature, y) AS DOUBLE) AS ny,
    CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS nt
  FROM (SELECT feature, y, len(list_filter(cuts, lambda c: v > c)) AS bin, CAST(count(*) AS DOUBLE) AS n
    FROM (SELECT *, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) OVER (PARTITION BY feature) AS cuts
      FROM (SELECT 'n_chars' AS feature, y, CAST(n_chars AS DOUBLE) AS v FROM lab UNION ALL SELECT 'toxic', y, CAST(toxic AS DOUBLE) FROM lab)) GROUP BY 1, 2, 3))
  GROUP BY feature""")
def mutual_information(spark, folder):
    return QL.mutual_information(P.labelled(spark, folder), "y", ["n_chars", "toxic"])


@query("A-40", Q.with_(Q.COUNTS, Q.series("zc")) + f"""SELECT CAST(count(DISTINCT timestamp) AS BIGINT) AS distinct_hours, CAST(count(DISTINCT zone_id) AS BIGINT) AS distinct_zones,
  CAST(date_diff('hour', min(timestamp), max(timestamp)) AS BIGINT) AS span_hours, date_diff('hour', min(timestamp), max(timestamp)) >= 24 AS ready,
  {Q.r('avg(CASE WHEN l24 IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)')} AS taxi_lag_24h_coverage FROM raw_series""")
def training_coverage(spark, folder):
    from pyspark.sql import Window as W

    w = W.partitionBy("zone_id").orderBy("timestamp")
    raw = P.zone_counts(spark, folder).withColumn("taxi_lag_24h", F.lag("taxi_count", 24).over(w))
    return QL.coverage(raw, ["taxi_lag_24h"])


@query("A-42", Q.with_(Q.COUNTS, Q.series("zc")) + f"""SELECT a AS lag_equals_current, b AS rolling_equals_current, a < 0.15 AS lag_ok, b < 0.10 AS rolling_ok FROM (
  SELECT {Q.r('avg(CASE WHEN lag1 = taxi_count THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS a,
  {Q.r('avg(CASE WHEN round_even(mean3, 0) = taxi_count THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS b FROM filled)""")
def leakage_audit(spark, folder):
    return QL.leakage_audit(FT.supply_series(P.zone_counts(spark, folder)))


@query("A-43", """SELECT 'n_chars' AS column_name, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS number, CAST(NULL AS VARCHAR) AS label FROM documents
  UNION ALL SELECT 'lang', NULL, (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)""")
def imputation_values(spark, folder):
    return QL.imputation_values(table(spark, folder, "documents"), ["n_chars"], ["lang"])
