"""Staging, cleaned and scored layers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.functions.geo import cell
from wirepulse.functions.scoring import as_of_column, intensity
from wirepulse.functions.timegrid import month_key
from wirepulse.operators.ranking import latest_per_key
from wirepulse.operators.validate import (
    has_event_code,
    valid_coordinates,
    valid_counts,
    valid_root_code,
)
from wirepulse.params import ScoreParams
from wirepulse.schemas import EVENT_COLUMNS


def stage(raw: DataFrame) -> DataFrame:
    """1:1 projection; ``load_seq`` is kept to break ties."""
    present = [c for c in [*EVENT_COLUMNS, "ingested_at", "load_seq"] if c in raw.columns]
    return raw.select(*present)


def newest_rows(staged: DataFrame) -> DataFrame:
    """The latest row of each event id."""
    order = [F.desc("date_added"), F.desc("ingested_at"), F.desc("load_seq")]
    return latest_per_key(staged, ["global_event_id"], order)


def usable() -> Column:
    """Whether the latest row of an event keeps all rules."""
    return valid_coordinates() & valid_counts() & has_event_code() & valid_root_code()


def clean(raw: DataFrame) -> DataFrame:
    """Latest row per event id, and only then the rules: an id whose latest row is bad vanishes."""
    return newest_rows(stage(raw)).filter(usable())


def score(
    cleaned: DataFrame,
    as_of: datetime | str | Column,
    params: ScoreParams = ScoreParams(),
    rounded: int | None = None,
) -> DataFrame:
    """Add ``intensity`` and ``scored_at``."""
    value = intensity(as_of, params)
    return cleaned.withColumns(
        {
            "intensity": F.round(value, rounded) if rounded is not None else value,
            "scored_at": as_of_column(as_of),
        }
    )


def clustered(rows: DataFrame) -> DataFrame:
    """Rows clustered by month and grid cell, then sorted by time, so a viewport query skips files and
    row groups by the min/max of ``lat``, ``lon`` and ``date_added``. The rebalance splits a hot cell
    and merges small ones at runtime, in a single pass over the input."""
    cells = {"_clat": cell(F.col("lat"), 8), "_clon": cell(F.col("lon"), 8)}
    return (
        rows.withColumns(cells).hint("rebalance", "month", "_clat", "_clon")
        .sortWithinPartitions("month", "_clat", "_clon", "date_added")
        .drop("_clat", "_clon")
    )


def write_scored(scored: DataFrame, path: str) -> None:
    """Full rebuild of the scored table; ``plans/scored_layer.py`` keeps one up load by load."""
    (
        clustered(scored.withColumn("month", month_key(F.col("date_added"))))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("month")
        .parquet(path)
    )
