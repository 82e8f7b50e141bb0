"""Column expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(x: Column) -> Column:
    """NaN and infinities are missing values: null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def seconds(t: Column) -> Column:
    """Seconds since the epoch with fractions."""
    return F.unix_micros(t.cast("timestamp")) / 1e6


def millis(t: Column) -> Column:
    """Whole milliseconds since the epoch, rounded: half a millisecond goes away from zero."""
    return F.round(F.unix_micros(t.cast("timestamp")) / 1000).cast("long")


def local_seconds(t: Column, offset_minutes: int = 0) -> Column:
    return seconds(t) + 60.0 * offset_minutes


def local_day(t: Column, offset_minutes: int = 0) -> Column:
    """Civil day by a fixed offset from UTC; no time zone rules."""
    return F.to_date(F.timestamp_micros(F.unix_micros(t.cast("timestamp")) + F.lit(60_000_000 * offset_minutes)))


def local_hour(t: Column, offset_minutes: int = 0) -> Column:
    """Decimal hour of the civil day."""
    return F.pmod(local_seconds(t, offset_minutes), F.lit(86400.0)) / 3600.0


def in_hours(hour: Column, begin: float, end: float) -> Column:
    """Whether an hour lies in [begin, end) on the clock, also past midnight."""
    return (hour >= begin) & (hour < end) if begin <= end else (hour >= begin) | (hour < end)


def zone(x: Column, lower: Column, upper: Column) -> Column:
    """below, between or above two thresholds; both bounds are between."""
    return F.when(x < lower, "below").when(x > upper, "above").otherwise("between")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Bounds of the score interval of a proportion k of n."""
    p, zz = ratio(k, n), z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
