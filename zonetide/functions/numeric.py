"""Robust casts, rounding and clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(value) -> Column:
    """A column from a name, a column or a constant."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def round_even(value, digits: int = 4) -> Column:
    """Round half to even on the scaled double.

    This is what array libraries do, and unlike ``round`` on a double it needs no
    detour through decimal text, so it stays cheap inside generated code.
    """
    scale = float(10 ** digits)
    return F.rint(col_of(value) * F.lit(scale)) / F.lit(scale)


def clip(value, low, high) -> Column:
    """Clamp to [low, high]; null stays null."""
    c = col_of(value)
    return F.when(c.isNull(), None).otherwise(
        F.least(F.greatest(c, F.lit(low).cast("double")), F.lit(high).cast("double")))


def finite(value, default=None) -> Column:
    """Null, NaN and the infinities become ``default``."""
    c = col_of(value).cast("double")
    bad = c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(default).cast("double")).otherwise(c)


def safe_double(value, default=0.0) -> Column:
    """Text or number to double; blanks, junk and NaN become ``default``."""
    parsed = col_of(value).cast("string").try_cast("double")
    return F.when(parsed.isNull() | F.isnan(parsed), F.lit(default).cast("double")).otherwise(parsed)


def safe_int(value, default: int = 0) -> Column:
    """Text or number to whole number, truncating towards zero."""
    parsed = col_of(value).cast("string").try_cast("double")
    ok = parsed.isNotNull() & ~F.isnan(parsed) & (F.abs(parsed) < F.lit(9.0e18))
    whole = F.when(parsed < 0, F.ceil(parsed)).otherwise(F.floor(parsed))
    return F.when(ok, whole).otherwise(F.lit(default).cast("long"))


def label_of(value, default: str = "unknown") -> Column:
    """Trimmed text, or ``default`` when nothing is left."""
    return F.coalesce(F.nullif(F.trim(col_of(value).cast("string")), F.lit("")), F.lit(default))


def share(part, whole, digits: int = 4) -> Column:
    """part / whole, 0 when there is nothing to divide by."""
    p, w = col_of(part).cast("double"), col_of(whole).cast("double")
    return round_even(F.when(w > 0, p / w).otherwise(F.lit(0.0)), digits)


def count_where(condition: Column) -> Column:
    """How many rows meet the condition (0, never null)."""
    return F.coalesce(F.count_if(condition), F.lit(0).cast("long"))
