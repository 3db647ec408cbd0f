"""Ingest validation: rule reasons and in-batch duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.dimensions import ROOT_CODES
from wirepulse.operators.ranking import latest_per_key

COUNTS = ["num_mentions", "num_sources", "num_articles"]
DUPLICATE = "duplicate_event_id_in_batch"


def valid_coordinates() -> Column:
    """Both present, within bounds, and not the (0, 0) placeholder."""
    lat, lon = F.col("lat"), F.col("lon")
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.coalesce(inside & ~((lat == 0) & (lon == 0)), F.lit(False))


def valid_counts() -> Column:
    mentions, sources, articles = (F.coalesce(F.col(c), F.lit(0)) >= 0 for c in COUNTS)
    return mentions & sources & articles


def has_event_code() -> Column:
    return F.coalesce(F.col("event_code"), F.lit("")) != ""


def valid_root_code() -> Column:
    """Membership in the fixed codes; a pattern with ``$`` would let a trailing newline pass."""
    return F.coalesce(F.col("event_root_code").isin(ROOT_CODES), F.lit(False))


def rule_reason() -> Column:
    """First rule a row breaks, or NULL."""
    return (
        F.when(~valid_coordinates(), "invalid_coordinates")
        .when(~valid_counts(), "negative_counts")
        .when(~has_event_code(), "missing_event_code")
    )


def validate_batch(parsed: DataFrame, batch: str = "cycle", order: str = "line_no") -> DataFrame:
    """Rows that pass the rules, then the last line per event id within each batch."""
    passed = parsed.filter(rule_reason().isNull())
    return latest_per_key(passed, [batch, "global_event_id"], [F.desc(order)])


def drop_counts(parsed: DataFrame, *keys: str, batch: str = "cycle") -> DataFrame:
    """(keys, reason, rows) of dropped rows; every repeat of an id in a batch is one drop.

    Counting first by (batch, id, reason) lets the map side combine, so neither a hot id nor a
    hot reason meets in one task.
    """
    groups = list(dict.fromkeys([*keys, batch]))
    per_id = (
        parsed.withColumn("reason", rule_reason())
        .groupBy(*groups, "reason", F.when(F.col("reason").isNull(), F.col("global_event_id")))
        .agg(F.count("*").alias("n"))
    )
    reason = F.coalesce("reason", F.lit(DUPLICATE))
    dropped = F.when(F.col("reason").isNull(), F.col("n") - 1).otherwise(F.col("n"))
    return (
        per_id.select(*keys, reason.alias("reason"), dropped.alias("n"))
        .groupBy(*keys, "reason")
        .agg(F.sum("n").alias("rows"))
        .filter("rows > 0")
    )
