"""Time-slider replay: what every slider position shows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirepulse.functions.scoring import as_of_column, intensity
from wirepulse.functions.timegrid import CYCLE_MINUTES, floor_minutes, tick_range, visible_ticks
from wirepulse.operators.events import time_filter
from wirepulse.operators.ranking import top_k_per_group
from wirepulse.params import ScoreParams

HISTORY_HOURS = 48
WINDOW_HOURS = 6


def explode_ticks(
    events: DataFrame, window_hours: int = WINDOW_HOURS, step_minutes: int = CYCLE_MINUTES
) -> DataFrame:
    """One row per event and slider position that can see it (at most 25); no range join."""
    return events.withColumn(
        "tick", F.explode(visible_ticks(F.col("date_added"), window_hours, step_minutes))
    )


def slider_replay(
    events: DataFrame,
    as_of: datetime | str | Column,
    history_hours: int = HISTORY_HOURS,
    window_hours: int = WINDOW_HOURS,
    limit: int = 1000,
    params: ScoreParams = ScoreParams(),
    salts: int = 16,
) -> DataFrame:
    """Top ``limit`` events per position of the last ``history_hours``, scored at the position."""
    end = floor_minutes(as_of_column(as_of))
    start = end - F.make_dt_interval(hours=F.lit(history_hours))
    reach = start - F.make_dt_interval(hours=F.lit(window_hours))
    recent = time_filter(events, reach, end)
    ticks = explode_ticks(recent, window_hours).filter(F.col("tick").between(start, end))
    scored = ticks.withColumn("effective_intensity", intensity(F.col("tick"), params))
    order = [F.desc(F.round("effective_intensity", 9)), F.asc("global_event_id")]
    return top_k_per_group(scored, ["tick"], order, limit, ["global_event_id"], salts, rank="rank")


def slider_counts(
    events: DataFrame, window_hours: int = WINDOW_HOURS, step_minutes: int = CYCLE_MINUTES
) -> DataFrame:
    """Visible events and their articles per slider position over the whole history; positions without
    events have no row.

    An event counts from its first position on and no longer behind its last one, so it is two changes,
    summed per position in each task first. The running sums go over one row for each position with a
    change, whatever the number of events: at most 35,000 a year. Positions between two changes repeat
    the sums of the first.
    """
    first, last = tick_range(F.col("date_added"), window_hours, step_minutes)
    step = F.make_dt_interval(mins=F.lit(step_minutes))
    articles = F.coalesce("num_articles", F.lit(0)).cast("bigint")
    one = F.lit(1).cast("bigint")
    change = lambda tick, sign: F.struct(
        tick.alias("tick"), (one * sign).alias("events"), (articles * sign).alias("articles")
    )
    changes = events.filter("date_added is not null").select(
        F.explode(F.array(change(first, 1), change(last + step, -1))).alias("c")
    )
    per_tick = changes.groupBy("c.tick").agg(F.sum("c.events").alias("events"), F.sum("c.articles").alias("articles"))
    order = Window.orderBy("tick")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    running = per_tick.select(
        "tick", F.lead("tick").over(order).alias("_next"), *[F.sum(c).over(so_far).alias(c) for c in ("events", "articles")]
    )
    shown = F.explode(F.sequence(F.col("tick"), F.col("_next") - step, step))
    return running.filter("events > 0").select(shown.alias("tick"), "events", "articles")
