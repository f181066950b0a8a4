"""Building blocks of the reference SQL (DuckDB dialect) for the same stand-ins."""

from __future__ import annotations

from zonetide import settings as S
from zonetide.plans.proxies import NOW, ZONE_ROWS


def r(x: str, digits: int = 4) -> str:
    """Half-even rounding on the scaled double."""
    scale = 10 ** digits
    return f"(round_even(CAST({x} AS DOUBLE) * {scale}.0::DOUBLE, 0) / {scale}.0::DOUBLE)"


def clip(x: str, low: str, high: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest(CAST({x} AS DOUBLE), {low}::DOUBLE), {high}::DOUBLE) END)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def n(x: str) -> str:
    """A count as BIGINT."""
    return f"CAST({x} AS BIGINT)"


def count_if(c: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT)"


def listed(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


NOW_SQL = f"TIMESTAMP '{NOW}'"

COUNTS = """zc AS (SELECT user_id % 5 + 1 AS zone_id, date_trunc('hour', ts) AS timestamp, CAST(count(*) AS BIGINT) AS taxi_count
  FROM events GROUP BY 1, 2)"""

DIM = "dim(zone_id, zone_name, region, zone_type) AS (VALUES " + ", ".join(
    f"({i}, '{a}', '{b}', '{c}')" for i, a, b, c in ZONE_ROWS) + ")"

RING = """ring AS (SELECT 'Zone' || a.zone_id AS zone, 'Zone' || b.zone_id AS neighbor FROM dim a JOIN dim b
  ON b.zone_id = (a.zone_id + 3) % 5 + 1 OR b.zone_id = a.zone_id % 5 + 1)"""

HOURS = f"""mid AS (SELECT quantile_cont(value, 0.5) AS m FROM events),
span AS (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events),
spine AS (SELECT dim.*, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS timestamp FROM dim, span),
zh AS (SELECT s.zone_id, s.timestamp, coalesce(e.taxi_count, 0) AS taxi_count, coalesce(e.rainfall_mm, 0.0::DOUBLE) AS rainfall_mm,
   coalesce(e.carpark_available_lots, 0) AS carpark_available_lots, s.zone_name, s.region, s.zone_type,
   coalesce(e.rainfall_mm, 0.0::DOUBLE) > 0.1 AS is_raining, coalesce({r('mean_value / (SELECT m FROM mid)')}, 1.0::DOUBLE) AS congestion_ratio
  FROM spine s LEFT JOIN (SELECT user_id % 5 + 1 AS zone_id, date_trunc('hour', ts) AS timestamp, CAST(count(*) AS BIGINT) AS taxi_count,
     {r("CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(12,2)) END), 0) AS DOUBLE) / 20.0", 2)} AS rainfall_mm,
     CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS carpark_available_lots,
     CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(value) AS mean_value
   FROM events GROUP BY 1, 2) e ON s.zone_id = e.zone_id AND s.timestamp = e.timestamp)"""

_LAGS = (1, 2, 3, 24, 48, 168)


def series(source: str = "zh") -> str:
    """Lags and rolling statistics over ``source``, raw and filled."""
    lag = ", ".join(f"lag(taxi_count, {k}) OVER w AS l{k}" for k in _LAGS)
    mean = ", ".join(f"avg(taxi_count) OVER (PARTITION BY zone_id ORDER BY timestamp ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS m{k}"
                     for k in (3, 6, 12, 24))
    std = ", ".join(f"stddev_samp(taxi_count) OVER (PARTITION BY zone_id ORDER BY timestamp ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS s{k}"
                    for k in (3, 6))
    edge = ", ".join(f"{f}(taxi_count) OVER (PARTITION BY zone_id ORDER BY timestamp ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS {f}3"
                     for f in ("max", "min"))
    fill = ", ".join(f"coalesce(l{k}, avg(l{k}) OVER (PARTITION BY zone_id)) AS lag{k}" for k in _LAGS)
    roll = ", ".join(f"coalesce(m{k}, avg(taxi_count) OVER (PARTITION BY zone_id)) AS mean{k}" for k in (3, 6, 12, 24))
    return f"""raw_series AS (SELECT *, {lag}, {mean}, {std}, {edge} FROM {source} WINDOW w AS (PARTITION BY zone_id ORDER BY timestamp)),
filled AS (SELECT *, {fill}, {roll}, coalesce(s3, 0.0) AS std3, coalesce(s6, 0.0) AS std6 FROM raw_series)"""


def drop_rate(before: str, now: str = "taxi_count") -> str:
    return clip(f"({before} - {now}) / ({before} + 1.0::DOUBLE)", "-2.0", "2.0")


RATES = f"""rated AS (SELECT *, {drop_rate('lag1')} AS depletion_rate_1h, {drop_rate('mean3')} AS depletion_rate_3h,
   {drop_rate('mean6')} AS depletion_rate_6h, {clip('taxi_count / (lag24 + 1.0::DOUBLE)', '0.0', '5.0')} AS supply_vs_yesterday,
   {clip('lag1 - taxi_count', '-200.0', '200.0')} AS taxi_abs_drop_1h FROM filled)"""

DELTA = f"""deltas AS (SELECT *, {clip('coalesce(depletion_rate_1h - lag(depletion_rate_1h) OVER (PARTITION BY zone_id ORDER BY timestamp), 0.0)', '-2.0', '2.0')}
   AS delta_depletion_1h FROM rated)"""

_LOCAL = "(timestamp + INTERVAL 8 HOUR)"
PI = "3.141592653589793::DOUBLE"


def school(day: str) -> str:
    return "(" + " OR ".join(f"{day} BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in S.SCHOOL_HOLIDAYS) + ")"


def holiday(day: str) -> str:
    return f"({day} IN (" + ", ".join(f"DATE '{d}'" for d in S.PUBLIC_HOLIDAYS) + "))"


def clock(source: str, name: str = "timed") -> str:
    """Local time fields over ``source``."""
    day = f"CAST({_LOCAL} AS DATE)"
    return f"""{name} AS (SELECT *, day_of_week >= 5 AS is_weekend, hour_of_day IN ({listed(S.MORNING_PEAK_HOURS + S.EVENING_PEAK_HOURS)}) AS is_peak_hour,
   least((31 - hour_of_day) % 24, (41 - hour_of_day) % 24) AS hours_to_peak
  FROM (SELECT *, CAST(hour({_LOCAL}) AS INTEGER) AS hour_of_day, CAST(isodow({_LOCAL}) - 1 AS INTEGER) AS day_of_week,
     CAST(month({_LOCAL}) AS INTEGER) AS month, {holiday(day)} AS is_holiday, {holiday(f"({day} + 1)")} AS is_eve_holiday,
     {school(day)} AS is_school_holiday FROM {source}))"""


INTENSITY = "CASE WHEN rainfall_mm <= 0 THEN 0 WHEN rainfall_mm <= 2 THEN 1 WHEN rainfall_mm <= 10 THEN 2 ELSE 3 END"


def level(x: str) -> str:
    return f"CASE WHEN {x} >= 0.7 THEN 'high' WHEN {x} >= 0.4 THEN 'medium' ELSE 'low' END"


def _bell(centre: float, width: float) -> str:
    z = f"((hour_of_day - {centre}::DOUBLE) / {width}::DOUBLE)"
    return f"exp(-0.5::DOUBLE * {z} * {z})"


PRESSURE = r(clip(
    f"0.35::DOUBLE * greatest({_bell(8.0, 1.8)}, {_bell(18.0, 2.0)}) + 0.10::DOUBLE * (CASE WHEN is_weekend THEN 0.35::DOUBLE ELSE 0.15::DOUBLE END)"
    f" + 0.20::DOUBLE * {clip('rain_intensity / 3.0::DOUBLE', '0.0', '1.0')} + 0.20::DOUBLE * 0.0::DOUBLE"
    f" + 0.15::DOUBLE * {clip('(congestion_ratio - 1.0::DOUBLE) / 0.8::DOUBLE', '0.0', '1.0')}", "0.0", "1.0"))

_BASE = "greatest(CASE WHEN baseline_supply <> 0 THEN baseline_supply ELSE CAST(taxi_count AS DOUBLE) END, 1.0::DOUBLE)"
_RATIO = clip(f"demand_pressure_score / greatest(taxi_count / {_BASE}, 0.05::DOUBLE) / 2.5::DOUBLE", "0.0", "1.0")
_DIFF = clip(f"(demand_pressure_score - {clip(f'taxi_count / {_BASE}', '0.0', '1.0')} + 1.0::DOUBLE) / 2.0::DOUBLE", "0.0", "1.0")
_SHORT = r(clip(f"0.45::DOUBLE * demand_pressure_score + 0.35::DOUBLE * delay_risk_score + 0.20::DOUBLE * (1.0::DOUBLE - least(taxi_count / {_BASE}, 1.0::DOUBLE))",
                "0.0", "1.0"))

TAG = """CASE WHEN tag_text = '' THEN 'normal conditions' ELSE tag_text END"""
_TAG_TEXT = """concat_ws(' + ', CASE WHEN depletion_rate_1h > 0.30 THEN 'rapid depletion' END,
   CASE WHEN depletion_rate_3h > 0.25 THEN 'sustained depletion' END,
   CASE WHEN taxi_count < 10 THEN 'critically low supply' WHEN taxi_count < 20 THEN 'low supply' END,
   CASE WHEN supply_vs_yesterday < 0.7 THEN 'below yesterday baseline' END,
   CASE WHEN is_raining OR rainfall_mm > 0 THEN 'rain' END,
   CASE WHEN is_peak_hour THEN 'peak hour' END, CASE WHEN is_holiday THEN 'public holiday' END)"""

SEVERITY = ("CASE WHEN predicted_shortage <= 0.25 THEN 'low' WHEN predicted_shortage <= 0.55 THEN 'moderate' "
            "WHEN predicted_shortage >= 0.85 THEN 'severe' ELSE 'high' END")

SCORED = f"""s1 AS (SELECT *, {r(clip('0.5::DOUBLE + depletion_rate_1h / 2.0::DOUBLE', '0.0', '1.0'))} AS delay_risk_score, {INTENSITY} AS rain_intensity,
   {r('coalesce(lag24, taxi_count)')} AS baseline_supply, {_TAG_TEXT} AS tag_text FROM timed WHERE lag1 IS NOT NULL),
s2 AS (SELECT *, {PRESSURE} AS demand_pressure_score, {TAG} AS explanation_tag FROM s1),
scored AS (SELECT *, {level('delay_risk_score')} AS risk_level, {level('demand_pressure_score')} AS demand_pressure_level,
   {r(f'{_RATIO} * 0.6::DOUBLE + {_DIFF} * 0.4::DOUBLE')} AS imbalance_score, {_SHORT} AS predicted_shortage FROM s2)"""

# The whole chain from events to scored rows.
TO_FEATURES = (DIM, HOURS, series(), RATES, DELTA, clock("deltas"))
TO_SCORED = (*TO_FEATURES, SCORED)


def policy(acute: str, elevated: str, calm: str) -> str:
    return (f"CASE WHEN delay_risk_score >= 0.75 OR imbalance_score >= 0.75 THEN '{acute}' WHEN delay_risk_score >= 0.45 "
            f"OR imbalance_score >= 0.45 OR taxi_count < 15 THEN '{elevated}' ELSE '{calm}' END")


OUTCOME = """CASE WHEN score_after IS NULL THEN NULL
   WHEN (CASE WHEN score_at_time > 0 THEN score_after / score_at_time ELSE 1.0::DOUBLE END) <= 0.70::DOUBLE THEN 'recovered'
   WHEN (CASE WHEN score_at_time > 0 THEN score_after / score_at_time ELSE 1.0::DOUBLE END) <= 0.90::DOUBLE THEN 'improved'
   WHEN (CASE WHEN score_at_time > 0 THEN score_after / score_at_time ELSE 1.0::DOUBLE END) >= 1.10::DOUBLE THEN 'worsened' ELSE 'unchanged' END"""

OUTCOME_LOG = f"""olog AS (SELECT *, {OUTCOME} AS outcome FROM (SELECT o_orderkey AS recommendation_id, o_custkey % 5 + 1 AS zone_id,
   'Zone' || CAST(o_custkey % 5 + 1 AS VARCHAR) AS zone_name, o_orderpriority AS action_type,
   o_orderpriority || '-' || CAST(o_custkey % 2 AS VARCHAR) AS action_id, o_orderdate AS logged_at,
   (o_orderkey % 100) / 100.0::DOUBLE AS score_at_time,
   CASE WHEN o_orderstatus <> 'O' THEN (o_custkey % 100) / 100.0::DOUBLE END AS score_after,
   CASE o_orderkey % 3 WHEN 0 THEN 'followed' WHEN 1 THEN 'not_followed' END AS followed_status, c_mktsegment AS root_cause,
   CASE WHEN (o_orderkey % 100) / 100.0::DOUBLE >= 0.7::DOUBLE THEN 'high' WHEN (o_orderkey % 100) / 100.0::DOUBLE >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS risk_level,
   CASE o_custkey % 4 WHEN 0 THEN 'peak' WHEN 1 THEN 'night' END AS intervention_window, o_custkey % 3 = 0 AS adjacent_risk_flag,
   CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) / 100000 AS DECIMAL(18,6)) AS DOUBLE) AS estimated_cost_sgd,
   CAST(o_orderkey % 11 - 5 AS DOUBLE) AS supply_delta_30m
  FROM orders JOIN customer ON o_custkey = c_custkey))"""

LABELLED = """lab AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality AS y, least(d.n_chars / 20000.0::DOUBLE, 1.0::DOUBLE) AS p
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

RUNS = """runs AS (SELECT 'run' || strftime(timestamp, '%Y%m%d%H') AS run_id, timestamp, all_rows - failed_rows AS rows_scored, failed_rows,
   flagged_zones, supply_now, flagged_zones / 10.0::DOUBLE AS psi, flagged_zones >= 4 AS drift_flag, 'v' || CAST(hour(timestamp) AS VARCHAR) AS model_version
  FROM (SELECT date_trunc('hour', ts) AS timestamp, CAST(count(*) AS BIGINT) AS all_rows, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed_rows,
    CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS supply_now, CAST(count(*) FILTER (WHERE value > 100) AS BIGINT) AS flagged_zones FROM events GROUP BY 1))"""


def _share(c: str) -> str:
    return r(f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")


VERSIONS = f"""months AS (SELECT *, month(m) + 12 * year(m) AS num FROM (SELECT date_trunc('month', o_orderdate) AS m,
   {_share("o_orderstatus = 'F'")} AS p0, {_share("o_orderstatus = 'O'")} AS r0, {_share("o_orderstatus <> 'P'")} AS f0, {_share('o_custkey % 10 < 7')} AS a0
  FROM orders GROUP BY 1)),
ver AS (SELECT 'v' || strftime(m, '%Y%m') AS version_id,
   CASE WHEN num % 3 <> 0 THEN 'candidate' WHEN m = (SELECT max(m) FROM months WHERE num % 3 = 0) THEN 'active' WHEN num % 2 = 0 THEN 'previous' ELSE 'rolled_back' END AS status,
   CAST(m AS TIMESTAMP) AS trained_at, CASE WHEN num % 3 = 0 THEN CAST(m AS TIMESTAMP) + INTERVAL 10 DAY END AS promoted_at,
   CASE WHEN num % 5 = 0 THEN 0.0::DOUBLE ELSE p0 END AS "precision", CASE WHEN num % 5 = 0 THEN 0.0::DOUBLE ELSE r0 END AS recall,
   CASE WHEN num % 5 = 0 THEN 0.0::DOUBLE ELSE f0 END AS f1, CASE WHEN num % 5 = 0 THEN 0.0::DOUBLE ELSE a0 END AS roc_auc FROM months),
ranked AS (SELECT *, greatest(trained_at, coalesce(promoted_at, trained_at)) AS recency FROM ver),
undertest AS (SELECT version_id FROM ranked WHERE status = 'candidate' ORDER BY recency DESC, version_id DESC LIMIT 1),
keptprev AS (SELECT version_id FROM ranked WHERE status = 'previous' ORDER BY recency DESC, version_id DESC LIMIT 2),
judged AS (SELECT *, CASE WHEN status = 'candidate' THEN "precision" <= 0 AND recall <= 0 AND f1 <= 0 AND roc_auc <= 0 AND version_id NOT IN (SELECT version_id FROM undertest)
   WHEN status = 'previous' THEN version_id NOT IN (SELECT version_id FROM keptprev) ELSE false END AS removable FROM ranked)"""
