"""Thresholds, costs and fixed values shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
# These lists and numbers decide results, so they are stated plainly.

LOCAL_TIMEZONE = "Asia/Singapore"

LATITUDE_RANGE = (1.15, 1.48)
LONGITUDE_RANGE = (103.60, 104.10)

MORNING_PEAK_HOURS = (7, 8, 9)
EVENING_PEAK_HOURS = (17, 18, 19, 20)
PEAK_STARTS = (7, 17)

RAIN_CODES = (61, 63, 65, 67, 80, 81, 82, 95, 96, 99)
VALID_WEATHER_CODES = (
    0, 1, 2, 3, 45, 48, 51, 53, 55, 61, 63, 65, 67, 71, 73, 75, 77,
    80, 81, 82, 85, 86, 95, 96, 99,
)
VALID_REGIONS = ("Central", "East", "West", "North", "North-East")
ZONE_TYPE_CODES = {
    "CBD": 0,
    "transport_hub": 1,
    "residential": 2,
    "mixed": 3,
    "industrial": 4,
}
DEFAULT_ZONE_TYPE = "mixed"

# Zones whose type differs from the default.
ZONE_TYPES_BY_NAME = {
    "CBD": (
        "Downtown Core", "Orchard", "Marina East", "Marina South", "Singapore River",
        "River Valley", "Museum", "Outram", "Rochor", "Straits View", "Kallang",
    ),
    "transport_hub": (
        "Changi", "Jurong East", "Woodlands", "Ang Mo Kio", "Tampines", "Bishan",
        "Toa Payoh", "Novena",
    ),
    "industrial": (
        "Tuas", "Pioneer", "Sungei Kadut", "Lim Chu Kang", "Western Islands",
        "Western Water", "Simpang",
    ),
}

REQUIRED_COLUMNS = ("zone_id", "timestamp", "taxi_count", "weather_code", "is_holiday")
RANGE_RULES = {"taxi_count": (0, 5000), "rainfall_mm": (0, 300)}

DEFAULT_RAIN_STATION = "S24"
RAINING_ABOVE_MM = 0.1

PUBLIC_HOLIDAYS = (
    "2024-01-01", "2024-02-10", "2024-02-11", "2024-03-29", "2024-04-10", "2024-05-01",
    "2024-05-23", "2024-06-17", "2024-08-09", "2024-10-31", "2024-12-25",
    "2025-01-01", "2025-01-29", "2025-01-30", "2025-03-31", "2025-04-18", "2025-05-01",
    "2025-05-12", "2025-06-06", "2025-08-09", "2025-10-20", "2025-12-25",
    "2026-01-01", "2026-02-17", "2026-02-18", "2026-03-20", "2026-04-03", "2026-05-01",
    "2026-05-22", "2026-05-27", "2026-08-10", "2026-11-08", "2026-12-25",
)
# First and last day, both closed.
SCHOOL_HOLIDAYS = (
    ("2024-03-09", "2024-03-17"),
    ("2024-05-25", "2024-06-23"),
    ("2024-09-07", "2024-09-15"),
    ("2024-11-16", "2024-12-31"),
    ("2025-03-08", "2025-03-16"),
    ("2025-05-31", "2025-06-29"),
    ("2025-09-06", "2025-09-14"),
    ("2025-11-15", "2025-12-31"),
    ("2026-03-14", "2026-03-22"),
    ("2026-05-30", "2026-06-28"),
    ("2026-09-05", "2026-09-13"),
    ("2026-11-14", "2026-12-31"),
)

EXTERNAL_DEFAULTS = {
    "temperature_c": 28.0,
    "carpark_available_lots": 0,
    "congestion_ratio": 1.0,
    "train_disruption_flag": 0,
}
WEATHER_DEFAULTS = {
    "weather_code": 0,
    "rainfall_mm": 0.0,
    "is_raining": False,
    "temperature_c": 28.0,
}
PRESSURE_DEFAULTS = {
    "hour_of_day": 0,
    "day_of_week": 0,
    "is_weekend": False,
    "rainfall_mm": 0.0,
    "rain_intensity": 0,
    "congestion_ratio": 1.0,
    "train_disruption_flag": 0,
}

MODEL_FEATURES = (
    "hour_of_day", "day_of_week", "month", "is_weekend", "is_peak_hour",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
    "hours_to_peak",
    "taxi_count", "taxi_lag_1h", "taxi_lag_24h", "taxi_lag_168h",
    "taxi_rolling_3h", "taxi_rolling_6h",
    "depletion_rate_1h", "depletion_rate_3h", "supply_vs_yesterday",
    "delta_depletion_1h", "taxi_abs_drop_1h", "is_low_count",
    "rainfall_mm", "rainfall_sqrt", "is_raining", "rain_intensity", "temperature_c",
    "is_holiday", "is_eve_holiday", "is_school_holiday",
    "zone_type_encoded", "carpark_available_lots", "carpark_shortage_flag",
    "congestion_ratio",
)
DRIFT_FEATURES = (
    "taxi_count", "depletion_rate_1h", "supply_vs_yesterday", "rainfall_mm",
    "congestion_ratio",
)

LABEL_DROP_FACTOR = 0.6
HISTORY_DAYS = 14
OUTCOME_WINDOW_MINUTES = 30
MIN_EVIDENCE = 3
PRIORITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3}
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Action:
    """One lever a zone can be given."""

    name: str
    cost: float
    uplift: float
    cooldown_minutes: int
    spends_budget: bool = False
    needs_surplus: bool = False
    always_allowed: bool = False
    boost: float = 1.0


# Costs, uplifts and cooldowns, in the order ties are resolved.
ACTIONS = (
    Action("monitor", 0.0, 0.0, 0, always_allowed=True),
    Action("rebalance", 0.4, 0.18, 45, needs_surplus=True),
    Action("incentive", 1.5, 0.22, 60, spends_budget=True),
    Action("rebalance_plus_incentive", 2.1, 0.34, 90, spends_budget=True,
           needs_surplus=True, boost=1.2),
    Action("ops_alert", 0.2, 0.05, 15),
)
CANDIDATES = {
    "low": ("monitor",),
    "moderate": ("monitor", "rebalance", "incentive"),
    "high": ("rebalance", "incentive", "rebalance_plus_incentive", "ops_alert"),
    "severe": ("rebalance", "incentive", "rebalance_plus_incentive", "ops_alert"),
}


@dataclass(frozen=True)
class RiskSettings:
    """Score cut-offs for risk and pressure levels."""

    high: float = 0.70
    medium: float = 0.40


@dataclass(frozen=True)
class DecisionSettings:
    """Everything the decision operators need, in one value."""

    monitor_max: float = 0.25
    watch_max: float = 0.55
    severe_min: float = 0.85
    actions: tuple[Action, ...] = ACTIONS
    candidates: dict = field(default_factory=lambda: dict(CANDIDATES))
    daily_budget: float = 30.0
    persistence_threshold: int = 2
    surplus_buffer: float = 0.2
    reduction_weight: float = 1.0
    cost_weight: float = 0.35
    alert_penalty: float = 0.6
    alert_action: str = "ops_alert"
    fallback_action: str = "monitor"

    def action(self, name: str) -> Action:
        return next(a for a in self.actions if a.name == name)

    @property
    def spending(self) -> tuple[Action, ...]:
        """Actions that draw on the budget, cheapest first."""
        return tuple(sorted((a for a in self.actions if a.spends_budget), key=lambda a: a.cost))

    @property
    def most_spends(self) -> int:
        """Upper bound on spends per budget, a property of the settings alone."""
        return int(self.daily_budget // self.spending[0].cost) + 1
