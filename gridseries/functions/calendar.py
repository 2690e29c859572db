"""Scalar functions of time and names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_MINUTES = 15
SLOTS_A_DAY = 96


def floor_time(ts: Column, minutes: int = STEP_MINUTES) -> Column:
    """The grid slot of a time; the step divides a day.  Keeps the type, and null."""
    over = F.pmod(F.hour(ts) * 60 + F.minute(ts), F.lit(minutes))
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), over, F.date_part(F.lit("SECOND"), ts))


def shift(ts: Column, steps: Column | int, minutes: int = STEP_MINUTES) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), (F.lit(steps) if isinstance(steps, int) else steps) * minutes)


def shift_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))


def slot_id(ts: Column) -> Column:
    """0 to 95."""
    return F.hour(ts) * 4 + F.floor(F.minute(ts) / 15).cast("int")


def _waves(x: Column, name: str) -> dict[str, Column]:
    return {f"{name}_sin": F.sin(x * (2 * math.pi)), f"{name}_cos": F.cos(x * (2 * math.pi))}


def weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def day_ahead_features(ts: Column) -> dict[str, Column]:
    """Calendar features of the day-ahead table: the hour counts in whole hours, months run from 1."""
    parts = {"hour": F.hour(ts), "minute": F.minute(ts), "weekday": F.weekday(ts), "month": F.month(ts), "is_weekend": weekend(ts)}
    return parts | _waves(F.hour(ts) / 24, "hour") | _waves(F.weekday(ts) / 7, "weekday") | _waves(F.month(ts) / 12, "month")


def _hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60


def target_time_features(ts: Column) -> dict[str, Column]:
    """Calendar features of a target time: fractional hour, day of year, slot."""
    parts = {"hour": F.hour(ts), "minute": F.minute(ts), "weekday": F.weekday(ts), "month": F.month(ts), "dayofyear": F.dayofyear(ts), "is_weekend": weekend(ts), "slot": slot_id(ts)}
    return parts | _waves(_hour_of_day(ts) / 24, "hour") | _waves(F.dayofyear(ts) / 365.25, "doy")


def decision_time_features(ts: Column) -> dict[str, Column]:
    """Calendar features of a decision time: fractional hour, months from 0."""
    return _waves(_hour_of_day(ts) / 24, "hour") | _waves(F.weekday(ts) / 7, "weekday") | _waves((F.month(ts) - 1) / 12, "month")


def segment(ts: Column, hours: int = 8) -> Column:
    """0, 1, 2 for the three thirds of a day."""
    return F.floor(F.hour(ts) / hours).cast("int")


def file_stem(name: Column, most: int = 120) -> Column:
    """A name that is safe in a path: bad characters and spaces become _, those at the ends go, 120 characters at most."""
    safe = F.regexp_replace(name, r'[\\/:*?"<>|\s]+', "_")
    return F.substring(F.regexp_replace(safe, "^_+|_+$", ""), 1, most)


def horizon_name(variable: Column, h: Column) -> Column:
    return F.format_string("%s_h%02d", variable, h)
