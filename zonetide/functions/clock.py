"""Time and calendar expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions.numeric import col_of


def local_time(ts, tz: str = S.LOCAL_TIMEZONE) -> Column:
    """Wall-clock time of a UTC instant."""
    return F.from_utc_timestamp(col_of(ts), tz)


def instant(ts, tz: str = S.LOCAL_TIMEZONE) -> Column:
    """UTC instant of a wall-clock time."""
    return F.to_utc_timestamp(col_of(ts), tz)


def parse_iso(text) -> Column:
    """ISO text to an instant: no offset means UTC, junk becomes null."""
    return F.trim(col_of(text).cast("string")).try_cast("timestamp")


def parse_iso_or_epoch_start(text) -> Column:
    """As :func:`parse_iso`, with the oldest representable day standing in for junk."""
    return F.coalesce(parse_iso(text), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def iso_text(text) -> Column:
    """Normalised ISO text, empty when it cannot be read."""
    return F.coalesce(F.date_format(parse_iso(text), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"), F.lit(""))


def hour_floor(ts) -> Column:
    return F.date_trunc("hour", col_of(ts))


def is_weekend(local) -> Column:
    return F.weekday(col_of(local)) >= 5


def is_peak_hour(local) -> Column:
    return F.hour(col_of(local)).isin(*(S.MORNING_PEAK_HOURS + S.EVENING_PEAK_HOURS))


def on_circle(value, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a cyclic value."""
    angle = col_of(value) * F.lit(2.0 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def hours_to_peak(hour) -> Column:
    """Hours until the next peak starts, 0 inside a starting hour."""
    return F.least(*[F.pmod(F.lit(start) - col_of(hour), F.lit(24)) for start in S.PEAK_STARTS])


def is_holiday(day, holidays: Iterable[str] = S.PUBLIC_HOLIDAYS) -> Column:
    """Membership in a short calendar; longer ones join a calendar table instead."""
    return F.to_date(col_of(day)).isin(*holidays)


def is_holiday_eve(day, holidays: Iterable[str] = S.PUBLIC_HOLIDAYS) -> Column:
    return is_holiday(F.date_add(F.to_date(col_of(day)), 1), holidays)


def is_school_holiday(day, ranges: Iterable[tuple[str, str]] = S.SCHOOL_HOLIDAYS) -> Column:
    """Whether the day lies in any range, both ends included."""
    d = F.to_date(col_of(day))
    inside = F.lit(False)
    for first, last in ranges:
        inside = inside | d.between(first, last)
    return inside


def minutes_since(ts, now) -> Column:
    """Whole minutes from ``ts`` to ``now``."""
    return F.timestamp_diff("MINUTE", col_of(ts), col_of(now))
