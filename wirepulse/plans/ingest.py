"""One ingest cycle, or many at once: lines -> classified -> validated -> titled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.operators.validate import validate_batch
from wirepulse.sources.event_export import classify_lines, good_rows


def attach_titles(events: DataFrame, titles: DataFrame, *keys: str) -> DataFrame:
    """Set ``page_title`` by URL (and ``keys``, such as the cycle); events without URL keep NULL.

    Titles are broadcast only when Spark's size estimate allows it. In a shuffled join a URL that
    very many events share is split by the skew join, and events without URL get a key of their
    own, so they do not meet in one task.
    """
    lookup = titles.select(*keys, F.col("url").alias("_url"), "page_title")
    own = F.concat(F.lit("\0"), F.col("global_event_id").cast("string"))
    keyed = events.drop("page_title").withColumn("_url", F.coalesce("source_url", own))
    return keyed.join(lookup, [*keys, "_url"], "left").select(*events.columns)


def ingest(lines: DataFrame, titles: DataFrame, *title_keys: str) -> tuple[DataFrame, DataFrame]:
    """(classified, loaded): every line with its reject reason, and the rows to load."""
    classified = classify_lines(lines)
    valid = validate_batch(good_rows(classified))
    return classified, attach_titles(valid, titles, *title_keys)
