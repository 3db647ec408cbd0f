"""Daily rollup and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.functions.geo import cell
from wirepulse.functions.scoring import as_of_column
from wirepulse.functions.timegrid import month_key, month_start
from wirepulse.params import RetentionParams

ROLLUP_KEYS = ["day", "cell_lat", "cell_lon", "event_root_code"]
Instant = datetime | str | Column


def daily_rollup(raw: DataFrame, params: RetentionParams = RetentionParams()) -> DataFrame:
    """Per day, grid cell and root code: mean position, events, articles, sources, mean tone."""
    return raw.groupBy(
        F.to_date("date_added").alias("day"),
        cell(F.col("lat"), params.cell_degrees).alias("cell_lat"),
        cell(F.col("lon"), params.cell_degrees).alias("cell_lon"),
        "event_root_code",
    ).agg(
        F.avg("lat").alias("rep_lat"),
        F.avg("lon").alias("rep_lon"),
        F.count("*").alias("event_count"),
        F.sum("num_articles").alias("total_articles"),
        F.sum("num_sources").alias("total_sources"),
        F.avg("avg_tone").alias("avg_tone"),
    )


def insert_absent(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``existing`` yet; what a re-run would append."""
    return incoming.join(existing.select(*ROLLUP_KEYS), ROLLUP_KEYS, "left_anti")


def cutoff(as_of: Instant, params: RetentionParams = RetentionParams()) -> Column:
    return as_of_column(as_of) - F.make_dt_interval(days=F.lit(params.retention_days))


def first_kept(as_of: Instant, params: RetentionParams = RetentionParams()) -> Column:
    """A row goes only when its whole month ends by the cutoff, so everything before the start
    of the cutoff's month is expired: one range test that reaches the scan."""
    return month_start(cutoff(as_of, params))


def expired_rows(
    raw: DataFrame, as_of: Instant, params: RetentionParams = RetentionParams()
) -> DataFrame:
    bound = first_kept(as_of, params)
    rows = raw.filter(F.col("date_added") < bound)
    return rows.filter(F.col("month") < month_key(bound)) if "month" in raw.columns else rows


def retained_rows(
    raw: DataFrame, as_of: Instant, params: RetentionParams = RetentionParams()
) -> DataFrame:
    bound = first_kept(as_of, params)
    rows = raw.filter(F.col("date_added") >= bound)
    return rows.filter(F.col("month") >= month_key(bound)) if "month" in raw.columns else rows


def expired_partitions(
    partitions: DataFrame, as_of: Instant, params: RetentionParams = RetentionParams()
) -> DataFrame:
    """Partitions (name, lower, upper, rows) that end at or before the cutoff."""
    return partitions.filter(F.col("upper") <= cutoff(as_of, params))
