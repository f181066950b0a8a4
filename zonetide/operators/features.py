"""Zone-hour features: time, weather, lags, rolling statistics, depletion, calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions import clock, scoring
from zonetide.functions.numeric import clip, round_even
from zonetide.operators.enrich import with_defaults
from zonetide.operators.quantiles import counted_quantiles
from zonetide.operators.segments import chunked, numbered

LAGS = {"taxi_lag_1h": 1, "taxi_lag_24h": 24, "taxi_lag_168h": 168}
MORE_LAGS = {"taxi_lag_2h": 2, "taxi_lag_3h": 3, "taxi_lag_48h": 48}
MEANS = {"taxi_rolling_3h": 3, "taxi_rolling_6h": 6}
MORE_MEANS = {"taxi_rolling_12h": 12, "taxi_rolling_24h": 24}
COUNT = "taxi_count"


def time_features(df: DataFrame, ts: str = "timestamp", tz: str = S.LOCAL_TIMEZONE) -> DataFrame:
    """Local hour, weekday (Monday 0), month, weekend and peak flags, cyclic encodings."""
    local = clock.local_time(ts, tz)
    base = df.withColumns({
        "hour_of_day": F.hour(local), "day_of_week": F.weekday(local), "month": F.month(local)})
    cyclic = {}
    for name, source, period in (("hour", "hour_of_day", 24), ("dow", "day_of_week", 7), ("month", "month", 12)):
        cyclic[f"{name}_sin"], cyclic[f"{name}_cos"] = clock.on_circle(source, period)
    peaks = S.MORNING_PEAK_HOURS + S.EVENING_PEAK_HOURS
    return base.withColumns({
        "is_weekend": F.col("day_of_week") >= 5,
        "is_peak_hour": F.col("hour_of_day").isin(*peaks),
        "hours_to_peak": clock.hours_to_peak("hour_of_day"),
        **cyclic})


def weather_features(df: DataFrame) -> DataFrame:
    """Rain flag, intensity class and damped rainfall, from whatever weather is present."""
    raining = scoring.rain_flag("weather_code") if "weather_code" in df.columns else F.lit(False)
    out = with_defaults(df, {"rainfall_mm": 0.0}, fill=False)
    if "is_raining" not in df.columns:
        out = out.withColumn("is_raining", raining)
    return out.withColumns({"rain_intensity": scoring.rain_intensity("rainfall_mm"),
                            "rainfall_sqrt": F.sqrt("rainfall_mm")})


def _raw_series(df: DataFrame, w, lags: dict, means: dict, stats: bool) -> DataFrame:
    """Everything that looks back along the series, still null where there is no history."""
    c = F.col(COUNT)
    cols: dict[str, Column] = {name: F.lag(c, k).over(w) for name, k in {**lags, "_lag_2": 2}.items()}
    cols |= {name: F.avg(c).over(w.rowsBetween(-k, -1)) for name, k in means.items()}
    if stats:
        for k in (3, 6):
            cols[f"taxi_rolling_{k}h_std"] = F.stddev_samp(c).over(w.rowsBetween(-k, -1))
        cols["taxi_rolling_3h_max"] = F.max(c).over(w.rowsBetween(-3, -1))
        cols["taxi_rolling_3h_min"] = F.min(c).over(w.rowsBetween(-3, -1))
    return df.withColumns(cols)


def supply_series(df: DataFrame, more: bool = False, segment_rows: int | None = None,
                  trailing: bool = False, low_counts: bool = False) -> DataFrame:
    """Lags and rolling statistics per zone, filled with zone means where history is missing.

    ``more`` adds the wider set (lags 2, 3, 48; means 12, 24; deviations; range). One shuffle by
    zone serves every window. ``segment_rows`` cuts long series into chunks instead.
    ``trailing`` fills from earlier rows only rather than from the whole series.
    """
    lags = {**LAGS, **(MORE_LAGS if more else {})}
    means = {**MEANS, **(MORE_MEANS if more else {})}
    flags = {"_p20": (COUNT, 0.20)} if low_counts else {}
    if low_counts and "carpark_available_lots" in df.columns:
        flags["_p25"] = ("carpark_available_lots", 0.25)
    if segment_rows:
        cut = chunked(numbered(df, ["zone_id"], "timestamp"), segment_rows, back=max(lags.values()))
        raw = _raw_series(cut, W.partitionBy("zone_id", "_chunk").orderBy("_pos"), lags, means, more)
        raw = raw.filter("_own").drop("_pos", "_chunk", "_own")
        whole = raw.groupBy("zone_id").agg(
            F.avg(COUNT).alias("_mean"), *[F.avg(n).alias(f"_mean_{n}") for n in lags])
        filled = raw.join(whole, "zone_id")
        for name, (source, p) in flags.items():
            filled = filled.join(counted_quantiles(df, source, {name: p}, ["zone_id"]), "zone_id")
    else:
        order = W.partitionBy("zone_id").orderBy("timestamp")
        zone = (order.rowsBetween(W.unboundedPreceding, -1) if trailing else W.partitionBy("zone_id"))
        filled = _raw_series(df, order, lags, means, more).withColumns({
            "_mean": F.avg(COUNT).over(zone), **{f"_mean_{n}": F.avg(n).over(zone) for n in lags},
            **{name: F.percentile(source, p).over(W.partitionBy("zone_id"))
               for name, (source, p) in flags.items()}})
    # Depletion of the previous row, from its own lags, so no second pass over the series is needed.
    before = scoring.relative_drop(F.coalesce("_lag_2", "_mean_taxi_lag_1h"), "taxi_lag_1h")
    cols = {"_depletion_before": before}
    cols |= {n: F.coalesce(F.col(n), F.col(f"_mean_{n}")) for n in lags}
    cols |= {n: F.coalesce(F.col(n), F.col("_mean")) for n in means}
    if more:
        cols |= {f"taxi_rolling_{k}h_std": F.coalesce(F.col(f"taxi_rolling_{k}h_std"), F.lit(0.0)) for k in (3, 6)}
        cols["taxi_rolling_3h_range"] = F.col("taxi_rolling_3h_max") - F.col("taxi_rolling_3h_min")
    if low_counts:
        cols["is_low_count"] = (F.col(COUNT) <= F.col("_p20")).cast("int")
        cols["carpark_shortage_flag"] = ((F.col("carpark_available_lots") <= F.col("_p25")).cast("int")
                                         if "_p25" in flags else F.lit(0))
    scratch = ["_lag_2", "_mean", *[f"_mean_{n}" for n in lags], *flags]
    return filled.withColumns(cols).drop(*scratch)


def depletion_features(df: DataFrame, more: bool = False) -> DataFrame:
    """Depletion rates, comparison with yesterday, acceleration and absolute drop."""
    lag1 = F.col("taxi_lag_1h")
    cols = {
        "depletion_rate_1h": scoring.relative_drop(lag1, COUNT),
        "depletion_rate_3h": scoring.relative_drop("taxi_rolling_3h", COUNT),
        "supply_vs_yesterday": scoring.relative_level(COUNT, "taxi_lag_24h"),
        "taxi_abs_drop_1h": clip(lag1 - F.col(COUNT), -200.0, 200.0),
    }
    if more:
        cols["depletion_rate_6h"] = scoring.relative_drop("taxi_rolling_6h", COUNT)
        cols["supply_trend_3v6"] = F.col("taxi_rolling_3h") - F.col("taxi_rolling_6h")
        cols["supply_trend_6v12"] = F.col("taxi_rolling_6h") - F.col("taxi_rolling_12h")
    out = df.withColumns(cols)
    late = {"delta_depletion_1h": clip(F.coalesce(
        F.col("depletion_rate_1h") - F.col("_depletion_before"), F.lit(0.0)), -2.0, 2.0)}
    if more:
        late["depletion_3v1"] = clip(F.col("depletion_rate_3h") - F.col("depletion_rate_1h"), -2.0, 2.0)
    return out.withColumns(late).drop("_depletion_before")


def rain_interactions(df: DataFrame) -> DataFrame:
    """Rain in peak hours, and rainfall while supply is falling."""
    return df.withColumns({
        "rain_x_peak": F.col("is_raining").cast("int") * F.col("is_peak_hour").cast("int"),
        "rain_x_depletion": F.col("rainfall_mm") * F.greatest("depletion_rate_1h", F.lit(0.0))})


def calendar_features(df: DataFrame, ts: str = "timestamp", tz: str = S.LOCAL_TIMEZONE,
                      calendar: DataFrame | None = None) -> DataFrame:
    """Holiday, holiday-eve and school-holiday flags.

    ``calendar`` (day, is_holiday, is_eve_holiday, is_school_holiday) replaces the built-in dates;
    it joins on the local day. One calendar serves training and scoring alike.
    """
    local = clock.local_time(ts, tz)
    if calendar is not None:
        joined = df.withColumn("_day", F.to_date(local)).join(calendar.withColumnRenamed("day", "_day"), "_day", "left")
        flags = ("is_holiday", "is_eve_holiday", "is_school_holiday")
        return joined.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags}).drop("_day")
    cols = {"is_eve_holiday": clock.is_holiday_eve(local)}
    if "is_holiday" not in df.columns:
        cols["is_holiday"] = clock.is_holiday(local)
    if "is_school_holiday" not in df.columns:
        cols["is_school_holiday"] = clock.is_school_holiday(local)
    return df.withColumns(cols)


def build_features(df: DataFrame, tz: str = S.LOCAL_TIMEZONE, more: bool = False,
                   segment_rows: int | None = None, trailing: bool = False) -> DataFrame:
    """The full feature table. Single-row zones drop out: they have no lag at all."""
    out = time_features(df, tz=tz)
    out = weather_features(out)
    had_lots = "carpark_available_lots" in df.columns
    out = with_defaults(out, {k: v for k, v in S.EXTERNAL_DEFAULTS.items()
                              if had_lots or k != "carpark_available_lots"}, fill=False)
    out = supply_series(out, more, segment_rows, trailing, low_counts=True)
    out = with_defaults(out, S.EXTERNAL_DEFAULTS, fill=False)
    out = depletion_features(out, more)
    zone_type = F.col("zone_type") if "zone_type" in df.columns else F.lit(None).cast("string")
    out = out.withColumn("zone_type_encoded", scoring.zone_type_code(zone_type))
    out = calendar_features(out, tz=tz)
    return out.filter(F.col("taxi_lag_1h").isNotNull())


def next_hour_label(df: DataFrame, factor: float = S.LABEL_DROP_FACTOR, drop_last: bool = False,
                    out: str = "supply_shortage") -> DataFrame:
    """1 when the zone's next row falls below ``factor`` of this one; the last row is 0 (or dropped)."""
    w = W.partitionBy("zone_id").orderBy("timestamp")
    labelled = df.withColumn("_next", F.lead(COUNT).over(w))
    if drop_last:
        labelled = labelled.filter(F.col("_next").isNotNull())
    hit = (F.col("_next") < F.col(COUNT) * F.lit(factor)).cast("int")
    return labelled.withColumn(out, F.coalesce(hit, F.lit(0))).drop("_next")


def model_columns(df: DataFrame, wanted=S.MODEL_FEATURES) -> list[str]:
    """Known features that are present, in model order."""
    return [c for c in wanted if c in df.columns]


def model_input(df: DataFrame, wanted=S.MODEL_FEATURES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Model columns only, flags as 0/1, nulls as 0."""
    kinds = dict(df.dtypes)
    cols = []
    for c in model_columns(df, wanted):
        v = F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)
        cols.append(F.coalesce(v, F.lit(0).cast("int" if kinds[c] == "boolean" else kinds[c])).alias(c))
    return df.select(*keep, *cols)


def rounded(df: DataFrame, columns, digits: int = 4) -> DataFrame:
    return df.withColumns({c: round_even(c, digits) for c in columns})
