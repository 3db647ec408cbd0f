"""Event and story queries of the API: filters, as-of ranking, top-k, latest run, statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.dimensions import codes_for_themes
from wirepulse.functions.geo import in_box
from wirepulse.functions.scoring import as_of_column, intensity
from wirepulse.functions.timegrid import month_key
from wirepulse.params import ScoreParams

Instant = datetime | str | Column


def bbox_filter(events: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Inclusive box on plain columns; literal bounds reach the Parquet scan."""
    return events.filter(
        F.col("lon").between(min(west, east), max(west, east))
        & F.col("lat").between(min(south, north), max(south, north))
    )


def time_filter(
    events: DataFrame, start: Instant | None = None, end: Instant | None = None
) -> DataFrame:
    """Inclusive window on ``date_added``; prunes the ``month`` partitions when there are any."""
    monthly = "month" in events.columns
    if start is not None:
        events = events.filter(F.col("date_added") >= as_of_column(start))
        if monthly:
            events = events.filter(F.col("month") >= month_key(as_of_column(start)))
    if end is not None:
        events = events.filter(F.col("date_added") <= as_of_column(end))
        if monthly:
            events = events.filter(F.col("month") <= month_key(as_of_column(end)))
    return events


def category_filter(
    events: DataFrame, categories: list[str] | None = None, themes: list[str] | None = None
) -> DataFrame:
    """Root codes given directly and through themes, merged; without any the filter is off."""
    codes = sorted(set(categories or []) | set(codes_for_themes(themes or [])))
    return events.filter(F.col("event_root_code").isin(codes)) if codes else events


def query_events(
    events: DataFrame,
    bbox: tuple[float, float, float, float] | None = None,
    start: Instant | None = None,
    end: Instant | None = None,
    categories: list[str] | None = None,
    themes: list[str] | None = None,
    at: Instant | None = None,
    limit: int = 500,
    params: ScoreParams = ScoreParams(),
) -> DataFrame:
    """The filtered events with the highest ``effective_intensity``, ties by id.

    With ``at`` the score is recomputed relative to that instant, which re-ranks history;
    otherwise the stored score is used.
    """
    if bbox is not None:
        events = bbox_filter(events, *bbox)
    events = category_filter(time_filter(events, start, end), categories, themes)
    effective = F.col("intensity") if at is None else intensity(at, params)
    ranked = events.withColumn("effective_intensity", effective)
    return ranked.orderBy(F.desc("effective_intensity"), "global_event_id").limit(limit)


def latest_run(stories: DataFrame) -> DataFrame:
    """Rows of the newest run; the maximum is a scalar subquery and prunes ``run_at``."""
    return stories.filter(F.col("run_at") == stories.agg(F.max("run_at")).scalar())


def query_stories(stories: DataFrame, limit: int = 500) -> DataFrame:
    """Stories of the newest run, highest intensity first, intensity capped at 1."""
    return rank_stories(latest_run(stories), limit)


def rank_stories(run: DataFrame, limit: int = 500) -> DataFrame:
    """The same of the stories of one run."""
    capped = run.withColumn("intensity", F.least(F.lit(1.0), "intensity"))
    return capped.orderBy(F.desc("intensity"), "story_id").limit(limit)


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("run_at")).limit(limit)


def pipeline_stats(events: DataFrame, stories: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: events, stories of the newest run, time and size of the last ingestion."""
    last = runs.agg(
        F.max("run_at").alias("last_ingestion_at"),
        F.max_by("rows_loaded", "run_at").alias("last_ingestion_rows"),
    )
    return last.select(
        events.agg(F.count("*")).scalar().alias("total_events"),
        latest_run(stories).agg(F.count("*")).scalar().alias("total_stories"),
        "last_ingestion_at",
        "last_ingestion_rows",
    )


def stories_or_events(stories: DataFrame, events: DataFrame, limit: int = 1000) -> DataFrame:
    """Map points: the stories, or the events when there is no story at all."""
    has_stories = stories.select(F.lit(1).alias("one")).limit(1).agg(F.count("*")).scalar()
    story_points = stories.select(
        F.lit("story").alias("kind"),
        F.col("story_id").alias("id"),
        F.col("summary").alias("title"),
        "lat",
        "lon",
        "intensity",
        F.col("total_articles").cast("bigint").alias("num_articles"),
    )
    event_points = events.filter(has_stories == 0).select(
        F.lit("event").alias("kind"),
        F.col("global_event_id").alias("id"),
        F.col("page_title").alias("title"),
        "lat",
        "lon",
        "intensity",
        F.col("num_articles").cast("bigint").alias("num_articles"),
    )
    return (
        story_points.unionByName(event_points)
        .orderBy(F.desc("intensity"), "id")
        .limit(limit)
    )
