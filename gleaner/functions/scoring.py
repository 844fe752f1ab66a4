"""Score terms shared by the gate and the feed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recency half-life in hours.
HALF_LIFE_HOURS = 48.0

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def age_hours(when: Column, now: Column) -> Column:
    """Null for an unknown date (``greatest`` alone would read it as new)."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(when)) / F.lit(float(MICROS_PER_HOUR)))
    return F.when(when.isNotNull(), age)


def age_days(when: Column, now: Column) -> Column:
    return age_hours(when, now) / F.lit(24.0)


def days_before(now: Column, days: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - days.cast("bigint") * MICROS_PER_DAY)


def recency(published: Column, now: Column) -> Column:
    """1 when new, halved every two days, 0 when the date is unknown."""
    return F.coalesce(F.pow(F.lit(2.0), -age_hours(published, now) / F.lit(HALF_LIFE_HOURS)), F.lit(0.0))


def exploration(item_id: Column) -> Column:
    """Stable pseudo-random value in [0, 1) from the characters of the id."""
    code = F.aggregate(
        F.filter(F.split(item_id, ""), lambda ch: ch != ""),
        F.lit(0).cast("bigint"),
        lambda acc, ch: F.pmod(acc * 31 + F.ascii(ch), F.lit(4_294_967_296)),
    )
    return F.pmod(code, F.lit(1000)) / F.lit(1000.0)


def iff(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))
