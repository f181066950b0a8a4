"""Operational views: zone lists, trends, alerts, freshness, zone performance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonetide.functions.numeric import count_where, label_of, round_even
from zonetide.operators.enrich import with_defaults

SCORE = "delay_risk_score"
ZONE_DEFAULTS = {
    "taxi_count": 0, "depletion_rate_1h": 0.0, "supply_vs_yesterday": 1.0, SCORE: 0.0, "demand_pressure_score": 0.0,
    "demand_pressure_level": "low", "imbalance_score": 0.0, "imbalance_level": "low", "policy_action": "no_action",
    "policy_reason": "", "predicted_shortage": 0.0, "severity_bucket": "low", "persistence_count": 0,
    "neighbor_surplus": 0.0, "recommended_action": "monitor", "action_reason": "", "estimated_action_cost": 0.0,
    "estimated_shortage_reduction": 0.0, "budget_remaining": 0.0, "risk_level": "low", "explanation_tag": "",
}


def _one_card_per_zone(cards: DataFrame, keep: str, order: str) -> DataFrame:
    pick = F.max_by if keep == "last" else F.min_by
    return cards.groupBy("zone_id").agg(pick("recommendation", order).alias("recommendation"))


def zone_list(now_rows: DataFrame, cards: DataFrame, risk_level: str | None = None, region: str | None = None,
              search: str | None = None, card_order: str = "last_updated") -> DataFrame:
    """Current zones, filtered case-insensitively, with the last card's text, riskiest first."""
    df = with_defaults(now_rows, ZONE_DEFAULTS)
    if risk_level:
        df = df.filter(F.col("risk_level") == risk_level.lower())
    if region:
        df = df.filter(F.lower("region") == region.lower())
    if search:
        df = df.filter(F.lower("zone_name").contains(search.lower()))
    joined = df.join(_one_card_per_zone(cards, "last", card_order), "zone_id", "left")
    return (joined.withColumn("recommendation", F.coalesce("recommendation", F.lit("No action required")))
            .withColumn("current_supply", F.col("taxi_count")).orderBy(F.col(SCORE).desc(), F.col("zone_id").asc()))


def zone_detail(now_rows: DataFrame, cards: DataFrame, zone_id: int, card_order: str = "last_updated") -> DataFrame:
    """One zone with its first card's text; no row when the zone is not there."""
    df = with_defaults(now_rows.filter(F.col("zone_id") == zone_id), ZONE_DEFAULTS)
    first = _one_card_per_zone(cards.filter(F.col("zone_id") == zone_id), "first", card_order)
    return df.join(first, "zone_id", "left").withColumn(
        "recommendation", F.coalesce("recommendation", F.lit("No action required")))


def top_zones(df: DataFrame, n: int = 5, score: str = SCORE) -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col("zone_id").asc()).limit(n)


def export_view(zones: DataFrame) -> DataFrame:
    """Chosen zone columns with four-decimal text, ready for a quoted file."""
    text = lambda c: F.format_string("%.4f", F.col(c).cast("double")).alias(c)
    return zones.select("zone_id", "zone_name", "region", "risk_level", text(SCORE), "current_supply",
                        text("supply_vs_yesterday"), text("depletion_rate_1h"), "explanation_tag",
                        F.coalesce("recommendation", F.lit("")).alias("recommendation"))


def trend(runs: DataFrame, field: str, fallback: str | None = None) -> DataFrame:
    """(timestamp, value) points of a run field; the older field only when the new one is empty throughout."""
    value = F.col(field) if field in runs.columns else F.lit(None)
    if fallback and fallback in runs.columns:
        if field not in runs.columns:
            value = F.col(fallback)
        else:
            none_at_all = runs.agg(F.count(field)).scalar() == 0
            value = F.when(none_at_all, F.col(fallback)).otherwise(value)
    return runs.select("timestamp", value.alias("value")).filter(F.col("timestamp").isNotNull() & F.col("value").isNotNull())


def recent_points(points: DataFrame, hours: int, ts: str = "timestamp") -> DataFrame:
    """Points within ``hours`` of the newest one; if no time can be read, all points."""
    parsed = points.withColumn("_at", F.col(ts).cast("string").try_cast("timestamp"))
    newest = parsed.agg(F.max("_at")).scalar()
    inside = F.col("_at") >= newest - F.make_interval(hours=F.lit(hours))
    return parsed.filter(inside | newest.isNull()).drop("_at")


def newest(df: DataFrame, n: int, by: str = "timestamp", ties: tuple[str, ...] = ()) -> DataFrame:
    """The n newest rows (a distributed top-k)."""
    return df.orderBy(F.col(by).desc(), *[F.col(t).desc() for t in ties]).limit(n)


def spark_points(df: DataFrame, ts: str, value: str, tail: int | None = None) -> DataFrame:
    """Points with both fields present, oldest first, optionally only the newest ``tail``."""
    pts = df.select(F.col(ts).alias("timestamp"), F.col(value).alias("value")).dropna()
    return (newest(pts, tail) if tail else pts).orderBy("timestamp", "value")


def newest_per_alert(alerts: DataFrame) -> DataFrame:
    """The latest occurrence of each alert id (map-side combined)."""
    others = [c for c in alerts.columns if c != "alert_id"]
    return (alerts.groupBy("alert_id").agg(F.max_by(F.struct(*others), F.struct("created_at", "message")).alias("a"))
            .select("alert_id", "a.*"))


def recent_alerts(alerts: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Alerts no older than ``hours``; those without a readable time are kept."""
    at = F.col("created_at")
    return alerts.filter(at.isNull() | (at >= now - F.make_interval(hours=F.lit(hours))))


def all_alerts(logged: DataFrame, derived: DataFrame, now: Column) -> DataFrame:
    """Logged alerts of the last day plus derived ones, newest per id."""
    return newest_per_alert(recent_alerts(logged, now).unionByName(derived))


def snapshot_alerts(now_rows: DataFrame, drift_flag: Column, now: Column, many: int = 5) -> DataFrame:
    """Alerts that follow from the current snapshot: many high-risk zones, drift."""
    one = now_rows.agg(count_where(F.col("risk_level") == "high").alias("n_high"), F.count(F.lit(1)).alias("n"))
    # Alert wording.
    rows = F.array(
        F.struct(F.lit("HIGH_RISK_ZONES").alias("alert_id"), F.lit("high").alias("severity"),
                 F.concat(F.col("n_high").cast("string"), F.lit(" zones currently at high depletion risk")).alias("message"),
                 (F.col("n_high") >= many).alias("on")),
        F.struct(F.lit("DRIFT_DETECTED").alias("alert_id"), F.lit("high").alias("severity"),
                 F.lit("Model prediction drift detected — review recommended").alias("message"),
                 (drift_flag & (F.col("n") > 0)).alias("on")))
    return (one.select(F.explode(rows).alias("r")).filter("r.on")
            .select("r.alert_id", "r.severity", "r.message", F.lit(None).cast("int").alias("zone_id"), now.alias("created_at")))


def latest_or_default(rows: DataFrame, defaults: Mapping[str, object], by: str = "timestamp") -> DataFrame:
    """The newest row, or one row of defaults when there is none."""
    kinds = dict(rows.dtypes)
    blank = rows.sparkSession.range(1).select(*[F.lit(defaults.get(c)).cast(kinds[c]).alias(c) for c in rows.columns])
    either = newest(rows, 1, by).withColumn("_rank", F.lit(0)).unionByName(blank.withColumn("_rank", F.lit(1)))
    return either.orderBy("_rank").limit(1).drop("_rank")


def freshness(last_seen: DataFrame, now: Column, stale_seconds: int = 3600) -> DataFrame:
    """ok / degraded / down per service from the newest timestamp of its table.

    ``last_seen``: (service, last_updated).
    """
    age = F.timestamp_diff("SECOND", F.col("last_updated"), now)
    status = F.when(age.isNull(), "down").when(age > stale_seconds, "degraded").otherwise("ok")
    detail = (F.when(age.isNull(), "Output file not found")
              .when(age > stale_seconds, F.concat(F.lit("Last updated "), F.floor(age / F.lit(60)).cast("string"), F.lit(" min ago"))))
    return last_seen.select("service", status.alias("status"), detail.alias("detail"), "last_updated")


def window_days(days: int, kept: int | None = None) -> tuple[int, str | None]:
    """Requested days, one at least, and a note where the history keeps fewer (``kept``). The request is never cut."""
    asked = max(int(days), 1)
    if kept is None or asked <= kept:
        return asked, None
    # Note wording.
    return asked, (f"Requested {asked} days, but zone score history currently retains only the most recent {kept} days.")


def zone_performance(history: DataFrame, now: Column, days: int = 7, zones: DataFrame | None = None) -> DataFrame:
    """Per zone: mean score, time shares per level, recent against prior half, trend.

    ``history``: (timestamp, zone_id, score). One conditional aggregation.
    """
    used, _ = window_days(days)
    start = now - F.make_interval(days=F.lit(used))
    mid = now - F.make_interval(hours=F.lit(used * 12))
    s, t = F.col("score"), F.col("timestamp")
    part = lambda c: round_even(F.avg(c.cast("double")))
    exact = lambda c: F.sum(c.cast("decimal(18,6)")).cast("double") / F.nullif(F.count(c), F.lit(0))
    per = history.filter(t >= start).groupBy("zone_id").agg(
        round_even(exact(s)).alias("mean_score"), part(s >= 0.70).alias("pct_time_high"),
        part((s >= 0.40) & (s < 0.70)).alias("pct_time_medium"), part(s < 0.40).alias("pct_time_low"),
        (exact(F.when(t >= mid, s)) - exact(F.when(t < mid, s))).alias("_d"), F.count(F.lit(1)).alias("observations"))
    delta = F.coalesce("_d", F.lit(0.0))
    out = per.withColumns({"trend_delta": round_even(delta), "trend": F.when(delta < -0.05, "improving")
                          .when(delta > 0.05, "deteriorating").otherwise("stable")}).drop("_d")
    if zones is None:
        return out
    named = zones.groupBy("zone_id").agg(F.min_by(F.struct("zone_name", "region"), F.struct("zone_name", "region")).alias("z"))
    return out.join(named, "zone_id", "left").withColumns({
        "zone_name": F.coalesce(F.nullif(label_of("z.zone_name", ""), F.lit("")), F.col("zone_id").cast("string")),
        "region": label_of("z.region", "")}).drop("z")


def performance_lists(performance: DataFrame, n: int = 5) -> DataFrame:
    """Chronic, improving and deteriorating zones, n each, as one ranked table."""
    lists = (("chronic_high_risk", F.lit(True), -F.col("pct_time_high")),
             ("most_improved", F.col("trend") == "improving", F.col("trend_delta")),
             ("deteriorating", F.col("trend") == "deteriorating", -F.col("trend_delta")))
    tags = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(name).alias("list_name"), key.cast("double").alias("k")))
                                     for name, ok, key in lists]))
    long = performance.withColumn("_t", F.explode(tags)).select(*performance.columns, "_t.list_name", "_t.k")
    order = W.partitionBy("list_name").orderBy("k", "zone_id")
    return (long.withColumn("list_rank", F.row_number().over(order)).filter(F.col("list_rank") <= n).drop("k"))


def driver_digest(now_rows: DataFrame, n: int = 5) -> DataFrame:
    """Top zones for the operators' digest."""
    return top_zones(now_rows, n).select("zone_id", SCORE, "risk_level", "taxi_count", "explanation_tag")
