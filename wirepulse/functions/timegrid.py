"""Cycle keys, slider ticks and calendar months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CYCLE_MINUTES = 15


def floor_minutes(ts: Column, minutes: int = CYCLE_MINUTES) -> Column:
    """Start of the ``minutes``-wide slot within the hour (``minutes`` divides 60)."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz")
    slot = F.floor(F.minute(ts) / minutes).cast("int") * minutes
    return hour + F.make_dt_interval(mins=slot)


def cycle_key(ts: Column) -> Column:
    """``yyyyMMddHHmmss`` of the quarter hour that ``ts`` falls in."""
    return F.date_format(floor_minutes(ts), "yyyyMMddHHmmss")


def month_key(ts: Column) -> Column:
    """Value of the ``month`` partition column."""
    return F.date_format(ts, "yyyy-MM")


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def next_month(ts: Column) -> Column:
    return F.add_months(month_start(ts), 1).cast("timestamp_ntz")


def tick_range(ts: Column, window_hours: int = 6, step_minutes: int = CYCLE_MINUTES) -> tuple[Column, Column]:
    """The first and the last slider position ``t`` with ``t - window <= ts <= t``."""
    floor = floor_minutes(ts, step_minutes)
    step = F.make_dt_interval(mins=F.lit(step_minutes))
    first = F.when(floor == ts, floor).otherwise(floor + step)
    return first, floor + F.make_dt_interval(hours=F.lit(window_hours))


def visible_ticks(ts: Column, window_hours: int = 6, step_minutes: int = CYCLE_MINUTES) -> Column:
    """All slider positions of ``tick_range``; both ends are inclusive."""
    return F.sequence(*tick_range(ts, window_hours, step_minutes), F.make_dt_interval(mins=F.lit(step_minutes)))
