"""Stand-ins on the supplied tables: the data has no taxis, so events become pings.

Everything here is a plain DataFrame over the tables; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.functions.numeric import clip, round_even
from zonetide.operators import features as FT
from zonetide.operators import scoring as SC
from zonetide.operators.quantiles import counted_quantiles
from zonetide.operators.rollup import every_zone_hour
from zonetide.session import use_utc
from zonetide.sources.readers import table

ZONE_ROWS = (
    (1, "Zone1", "Central", "CBD"),
    (2, "Zone2", "East", "transport_hub"),
    (3, "Zone3", "West", "residential"),
    (4, "Zone4", "North", "mixed"),
    (5, "Zone5", "North-East", "industrial"),
)
ZONES = len(ZONE_ROWS)
MONEY = "decimal(12,2)"
# Times on one scale: the events cover January 2024.
NOW = "2024-01-31 00:00:00"


def now():
    """The moment reports look back from."""
    return F.lit(NOW).cast("timestamp")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Pings: an instant, a zone, a kind and a value."""
    e = table(use_utc(spark), folder, "events")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "zone_id": F.col("user_id") % ZONES + 1})


def inline_rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A literal table. As a local relation its size is known, so Spark decides on broadcasting by itself."""
    names, kinds = zip(*[field.split() for field in schema.split(", ")])
    values = [F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(row, names, kinds)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*values)))


def zone_dimension(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, ZONE_ROWS, "zone_id long, zone_name string, region string, zone_type string")


def ring(spark: SparkSession) -> DataFrame:
    """Each zone borders the ones before and after it."""
    pairs = [(f"Zone{i}", f"Zone{j}") for i in range(1, ZONES + 1) for j in ((i - 2) % ZONES + 1, i % ZONES + 1)]
    return inline_rows(spark, pairs, "zone string, neighbor string")


def zone_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pings per zone and hour."""
    from zonetide.operators.rollup import pings_per_zone_hour

    return pings_per_zone_hour(events(spark, folder), "ts", ("zone_id",))


def zone_hours(spark: SparkSession, folder: str, congestion: bool = False) -> DataFrame:
    """A row for every zone and hour of the events' span, with weather and external columns; hours without events count 0."""
    e = events(spark, folder)
    money = F.col("value").cast(MONEY)
    rain = F.coalesce(F.sum(F.when(F.col("event_type") == "error", money)).cast("double"), F.lit(0.0)) / F.lit(20.0)
    rolled = e.groupBy("zone_id", F.date_trunc("hour", "ts").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("taxi_count"), round_even(rain, 2).alias("rainfall_mm"),
        F.count_if(F.col("event_type") == "view").alias("carpark_available_lots"),
        (F.sum(money).cast("double") / F.count("value")).alias("_mean_value"))
    hour = F.date_trunc("hour", "ts")
    span = e.agg(F.min(hour).alias("first"), F.max(hour).alias("last"))
    filled = every_zone_hour(zone_dimension(spark), rolled, span, {"taxi_count": 0, "rainfall_mm": 0.0, "carpark_available_lots": 0})
    out = filled.withColumns({"is_raining": F.col("rainfall_mm") > 0.1, "train_disruption_flag": F.lit(0)})
    if congestion:
        mid = counted_quantiles(e, "value", {"mid": 0.5}).select("mid").scalar()
        out = out.withColumn("congestion_ratio", F.coalesce(round_even(F.col("_mean_value") / mid), F.lit(1.0)))
    return out.drop("_mean_value")


def newest_hour(spark: SparkSession, folder: str):
    """The newest zone-hour, from the events' time column alone."""
    return F.date_trunc("hour", events(spark, folder).agg(F.max("ts")).scalar())


def features(spark: SparkSession, folder: str, congestion: bool = False, **kw) -> DataFrame:
    return FT.build_features(zone_hours(spark, folder, congestion), **kw)


def risk():
    """Fixed stand-in for a model: half plus half the hourly depletion, within [0, 1]."""
    return clip(F.lit(0.5) + F.col("depletion_rate_1h") / F.lit(2.0), 0.0, 1.0)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return SC.score_table(features(spark, folder, congestion=True), risk())


def outcome_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as recommendations with outcomes, customers as zones."""
    from zonetide.functions.scoring import outcome_class

    o, c = table(use_utc(spark), folder, "orders"), table(spark, folder, "customer")
    before = (F.col("o_orderkey") % 100) / F.lit(100.0)
    after = F.when(F.col("o_orderstatus") != "O", (F.col("o_custkey") % 100) / F.lit(100.0))
    third = F.col("o_orderkey") % 3
    return (o.join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("recommendation_id"), (F.col("o_custkey") % ZONES + 1).alias("zone_id"),
        F.concat(F.lit("Zone"), (F.col("o_custkey") % ZONES + 1).cast("string")).alias("zone_name"),
        F.col("o_orderpriority").alias("action_type"),
        F.concat("o_orderpriority", F.lit("-"), (F.col("o_custkey") % 2).cast("string")).alias("action_id"),
        F.col("o_orderdate").cast("timestamp").alias("logged_at"), before.alias("score_at_time"), after.alias("score_after"),
        F.when(third == 0, "followed").when(third == 1, "not_followed").alias("followed_status"),
        F.col("c_mktsegment").alias("root_cause"),
        F.when(before >= 0.7, "high").when(before >= 0.4, "medium").otherwise("low").alias("risk_level"),
        F.when(F.col("o_custkey") % 4 == 0, "peak").when(F.col("o_custkey") % 4 == 1, "night").alias("intervention_window"),
        (F.col("o_custkey") % 3 == 0).alias("adjacent_risk_flag"),
        (F.col("o_totalprice").cast(MONEY) / F.lit(100000)).cast("decimal(18,6)").cast("double").alias("estimated_cost_sgd"),
        (F.col("o_orderkey") % 11 - 5).cast("double").alias("supply_delta_30m"),
    ).withColumn("outcome", F.when(F.col("score_after").isNotNull(), outcome_class("score_at_time", "score_after"))))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a label y and a fixed score p."""
    d, lab = table(use_utc(spark), folder, "documents"), table(spark, folder, "labels")
    return d.select("doc_id", "lang", "source", "n_chars").join(lab, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "toxic", F.col("quality").alias("y"),
        F.least(F.col("n_chars") / F.lit(20000.0), F.lit(1.0)).alias("p"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run per hour of events: scored and failed rows, drift, version."""
    e = events(spark, folder)
    per_hour = e.groupBy(F.date_trunc("hour", "ts").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("all_rows"), F.count_if(F.col("event_type") == "error").alias("failed_rows"),
        F.count_if(F.col("event_type") == "view").alias("supply_now"), F.count_if(F.col("value") > 100).alias("flagged_zones"))
    stamp = F.date_format("timestamp", "yyyyMMddHH")
    return per_hour.select(
        F.concat(F.lit("run"), stamp).alias("run_id"), "timestamp", (F.col("all_rows") - F.col("failed_rows")).alias("rows_scored"),
        "failed_rows", "flagged_zones", "supply_now", (F.col("flagged_zones") / F.lit(10.0)).alias("psi"),
        (F.col("flagged_zones") >= 4).alias("drift_flag"), F.concat(F.lit("v"), F.hour("timestamp").cast("string")).alias("model_version"))


def version_events(spark: SparkSession, folder: str) -> DataFrame:
    """Order months as model versions with a registration, and status changes for some."""
    o = table(use_utc(spark), folder, "orders")
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    share = lambda c: round_even(F.avg(c.cast("double")))
    per = o.groupBy(month.alias("month")).agg(
        share(F.col("o_orderstatus") == "F").alias("precision"), share(F.col("o_orderstatus") == "O").alias("recall"),
        share(F.col("o_orderstatus") != "P").alias("f1"), share(F.col("o_custkey") % 10 < 7).alias("roc_auc"))
    number = F.month("month") + F.lit(12) * F.year("month")
    blank = number % 5 == 0
    metrics = {m: F.when(blank, 0.0).otherwise(F.col(m)).alias(m) for m in ("precision", "recall", "f1", "roc_auc")}
    version = F.concat(F.lit("v"), F.date_format("month", "yyyyMM")).alias("version_id")
    none = F.lit(None).cast("timestamp")
    registered = per.select(version, F.lit("candidate").alias("status"), F.col("month").alias("at"), F.lit(0).alias("seq"),
                            F.col("month").alias("trained_at"), none.alias("promoted_at"), *metrics.values())
    later = F.col("month") + F.make_interval(days=F.lit(10))
    nothing = [F.lit(None).cast("double").alias(m) for m in metrics]
    newest = per.filter(number % 3 == 0).agg(F.max("month")).scalar()
    changed = per.filter(number % 3 == 0).select(
        version, F.when(F.col("month") == newest, "active").when(number % 2 == 0, "previous").otherwise("rolled_back").alias("status"),
        later.alias("at"), F.lit(1).alias("seq"), none.alias("trained_at"), later.alias("promoted_at"), *nothing)
    return registered.unionByName(changed)
