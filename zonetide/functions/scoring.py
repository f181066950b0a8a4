"""Risk, pressure, imbalance and shortage expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions.numeric import clip, col_of, round_even
from zonetide.settings import DecisionSettings, RiskSettings

RISK = RiskSettings()


def rain_intensity(mm) -> Column:
    """0 none, 1 light (up to 2 mm), 2 moderate (up to 10 mm), 3 heavy."""
    m = col_of(mm)
    return (F.when(m <= 0, 0).when(m <= 2, 1).when(m <= 10, 2).when(m > 10, 3)).cast("int")


def rain_flag(weather_code) -> Column:
    return F.coalesce(col_of(weather_code).isin(*S.RAIN_CODES), F.lit(False))


def relative_drop(before, now) -> Column:
    """Share of the earlier level that has gone, +1 guarded, within [-2, 2]."""
    b, n = col_of(before), col_of(now)
    return clip((b - n) / (b + F.lit(1.0)), -2.0, 2.0)


def relative_level(now, before) -> Column:
    """Current level over the earlier one, +1 guarded, within [0, 5]."""
    return clip(col_of(now) / (col_of(before) + F.lit(1.0)), 0.0, 5.0)


def zone_type_code(zone_type) -> Column:
    """Numeric zone type; unknown types count as mixed."""
    z = col_of(zone_type)
    out = None
    for name, code in S.ZONE_TYPE_CODES.items():
        out = F.when(z == name, code) if out is None else out.when(z == name, code)
    return out.otherwise(S.ZONE_TYPE_CODES[S.DEFAULT_ZONE_TYPE]).cast("int")


def level(score, settings: RiskSettings = RISK) -> Column:
    """high / medium / low by two cut-offs."""
    s = col_of(score)
    return F.when(s >= settings.high, "high").when(s >= settings.medium, "medium").otherwise("low")


def peak_pressure(hour) -> Column:
    """Two bell curves over the day; the larger one counts."""
    h = col_of(hour).cast("double")

    def bell(centre: float, width: float) -> Column:
        z = (h - F.lit(centre)) / F.lit(width)
        return F.exp(F.lit(-0.5) * z * z)

    return F.greatest(bell(8.0, 1.8), bell(18.0, 2.0))


def demand_pressure(hour="hour_of_day", weekend="is_weekend", intensity="rain_intensity",
                    disruption="train_disruption_flag", congestion="congestion_ratio") -> Column:
    """Weighted pressure proxy in [0, 1]."""
    day_term = F.when(col_of(weekend).cast("boolean"), F.lit(0.35)).otherwise(F.lit(0.15))
    rain = clip(col_of(intensity).cast("double") / F.lit(3.0), 0.0, 1.0)
    stopped = clip(col_of(disruption).cast("double"), 0.0, 1.0)
    slow = clip((col_of(congestion).cast("double") - F.lit(1.0)) / F.lit(0.8), 0.0, 1.0)
    total = (F.lit(0.35) * peak_pressure(hour) + F.lit(0.10) * day_term + F.lit(0.20) * rain
             + F.lit(0.20) * stopped + F.lit(0.15) * slow)
    return clip(total, 0.0, 1.0)


def _baseline(supply: Column, baseline: Column) -> Column:
    """The given baseline, or the current supply when it is null or zero; at least 1."""
    usable = baseline.isNotNull() & (baseline != 0)
    return F.greatest(F.when(usable, baseline).otherwise(supply), F.lit(1.0))


def ratio_imbalance(pressure, supply, baseline) -> Column:
    """Pressure over supply support, squeezed into [0, 1]."""
    p, s, b = (col_of(x).cast("double") for x in (pressure, supply, baseline))
    support = F.greatest(s, F.lit(0.0)) / _baseline(s, b)
    return clip(p / F.greatest(support, F.lit(0.05)) / F.lit(2.5), 0.0, 1.0)


def difference_imbalance(pressure, supply, baseline) -> Column:
    """Pressure minus supply support, mapped from [-1, 1] to [0, 1]."""
    p, s, b = (col_of(x).cast("double") for x in (pressure, supply, baseline))
    support = clip(s / _baseline(s, b), 0.0, 1.0)
    return clip((p - support + F.lit(1.0)) / F.lit(2.0), 0.0, 1.0)


def imbalance(pressure, supply, baseline) -> Column:
    """60 % ratio, 40 % difference, four decimals."""
    return round_even(ratio_imbalance(pressure, supply, baseline) * F.lit(0.6)
                      + difference_imbalance(pressure, supply, baseline) * F.lit(0.4))


def imbalance_level(score) -> Column:
    """As :func:`level`, with ``unknown`` for missing or non-finite scores."""
    s = col_of(score).cast("double")
    odd = s.isNull() | F.isnan(s) | s.isin(float("inf"), float("-inf"))
    return F.when(odd, "unknown").otherwise(level(s))


def predicted_shortage(pressure, supply, risk, baseline) -> Column:
    """Bounded stress index from pressure, depletion risk and the gap to the baseline."""
    p = clip(F.coalesce(col_of(pressure).cast("double"), F.lit(0.0)), 0.0, 1.0)
    r = clip(F.coalesce(col_of(risk).cast("double"), F.lit(0.0)), 0.0, 1.0)
    s = F.greatest(F.coalesce(col_of(supply).cast("double"), F.lit(0.0)), F.lit(0.0))
    gap = F.lit(1.0) - F.least(s / _baseline(s, col_of(baseline).cast("double")), F.lit(1.0))
    return round_even(clip(F.lit(0.45) * p + F.lit(0.35) * r + F.lit(0.20) * gap, 0.0, 1.0))


def severity(shortage, settings: DecisionSettings | None = None) -> Column:
    """low / moderate / high / severe; anything not finite is low."""
    cfg = settings or DecisionSettings()
    s = F.coalesce(col_of(shortage).cast("double"), F.lit(0.0))
    odd = F.isnan(s) | s.isin(float("inf"), float("-inf"))
    return (F.when(odd, "low").when(s <= cfg.monitor_max, "low").when(s <= cfg.watch_max, "moderate")
            .when(s >= cfg.severe_min, "severe").otherwise("high"))


def _policy(risk, imbalance_score, supply, acute, elevated, calm) -> Column:
    r, i, c = col_of(risk), col_of(imbalance_score), col_of(supply)
    return (F.when((r >= 0.75) | (i >= 0.75), acute)
            .when((r >= 0.45) | (i >= 0.45) | (c < 15), elevated).otherwise(calm))


def policy_action(risk, imbalance_score, supply) -> Column:
    return _policy(risk, imbalance_score, supply, "intervention", "watchlist", "no_action")


# The sentences shown beside each policy tier.
POLICY_REASONS = (
    "Heuristic baseline policy recommends intervention because depletion risk or imbalance is already high.",
    "Heuristic baseline policy recommends watchlist monitoring because signals are elevated but not yet acute.",
    "Heuristic baseline policy recommends no action because depletion risk and imbalance remain low.",
)


def policy_reason(risk, imbalance_score, supply) -> Column:
    return _policy(risk, imbalance_score, supply, *POLICY_REASONS)


def explanation_tag(have: set[str] | None = None) -> Column:
    """Reasons joined by ' + ' in a fixed order. Names not in ``have`` take their neutral value."""

    def field(name: str, neutral) -> Column:
        if have is not None and name not in have:
            return F.lit(neutral)
        return F.col(name)

    count = field("taxi_count", 50).cast("double")
    raining = (F.coalesce(field("is_raining", False).cast("boolean"), F.lit(False))
               | (F.coalesce(field("rainfall_mm", 0.0), F.lit(0.0)) > 0))
    # Wording and bands of the reasons.
    parts = [
        F.when(field("depletion_rate_1h", 0.0) > 0.30, "rapid depletion"),
        F.when(field("depletion_rate_3h", 0.0) > 0.25, "sustained depletion"),
        F.when(count < 10, "critically low supply").when(count < 20, "low supply"),
        F.when(field("supply_vs_yesterday", 1.0) < 0.7, "below yesterday baseline"),
        F.when(raining, "rain"),
        F.when(field("is_peak_hour", False).cast("boolean"), "peak hour"),
        F.when(field("is_holiday", False).cast("boolean"), "public holiday"),
    ]
    joined = F.concat_ws(" + ", *parts)
    return F.when(joined == "", "normal conditions").otherwise(joined)


def drivers_of(tag) -> Column:
    """The reasons inside a tag as an array; empty under normal conditions."""
    t = col_of(tag)
    pieces = F.filter(F.transform(F.split(t, r"\s*\+\s*|[,·|]"), F.trim), lambda p: p != "")
    return F.when(t.isNull() | (t == "normal conditions"), F.array().cast("array<string>")).otherwise(pieces)


def drift_level(psi) -> Column:
    """Monitor wording: stable / warning / alert."""
    p = col_of(psi)
    return F.when(p < 0.10, "stable").when(p < 0.25, "warning").otherwise("alert")


def psi_level(psi) -> Column:
    """Report wording: stable / moderate / significant."""
    p = col_of(psi)
    return F.when(p >= 0.25, "significant").when(p >= 0.10, "moderate").otherwise("stable")


def outcome_class(before, after) -> Column:
    """recovered / improved / worsened / unchanged by the ratio of scores."""
    b, a = col_of(before), col_of(after)
    ratio = F.when(b > 0, a / b).otherwise(F.lit(1.0))
    return (F.when(ratio <= 0.70, "recovered").when(ratio <= 0.90, "improved")
            .when(ratio >= 1.10, "worsened").otherwise("unchanged"))


def eta_bucket(minutes) -> Column:
    m = col_of(minutes)  # fixed values: bands and names
    return (F.when(m.isNull(), "unknown").when(m < 10, "under_10m").when(m < 20, "10_to_20m")
            .when(m < 45, "20_to_45m").otherwise("45m_plus"))


def confidence_band(sample) -> Column:
    n = col_of(sample)  # fixed values: bands and names
    return F.when(n >= 12, "high").when(n >= 6, "medium").otherwise("low")
