"""GeoJSON features of events and stories, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.functions.text import iso_utc

_KEEP_NULLS = {"ignoreNullFields": "false"}

EVENT_PROPERTIES = (
    "id bigint, title string, intensity double, num_articles int, num_sources int, "
    "num_mentions int, avg_tone double, event_code string, event_root_code string, "
    "quad_class int, date_added string, location string, country_code string, "
    "source_url string, actor1 string, actor2 string"
)
STORY_PROPERTIES = (
    "id bigint, summary string, member_count bigint, total_articles bigint, "
    "total_sources bigint, intensity double, avg_tone double, trend string, "
    "articles_last_hour bigint, articles_prev_hour bigint, location string, "
    "country_code string, source_urls array<string>, event_ids array<bigint>, "
    "earliest string, latest string, run_at string"
)


def _feature(lon: Column, lat: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.struct(
        F.lit("Feature").alias("type"),
        geometry.alias("geometry"),
        properties.alias("properties"),
    )


def event_features(events: DataFrame) -> DataFrame:
    """(id, feature) with the renamed event properties; the feature is JSON text."""
    properties = F.struct(
        F.col("global_event_id").alias("id"),
        F.col("page_title").alias("title"),
        F.col("effective_intensity").alias("intensity"),
        "num_articles", "num_sources", "num_mentions", "avg_tone", "event_code",
        "event_root_code", "quad_class",
        iso_utc(F.col("date_added")).alias("date_added"),
        F.col("action_geo_full_name").alias("location"),
        F.col("action_geo_country_code").alias("country_code"),
        "source_url",
        F.col("actor1_name").alias("actor1"),
        F.col("actor2_name").alias("actor2"),
    )
    feature = _feature(F.col("lon"), F.col("lat"), properties)
    return events.select(
        F.col("global_event_id").alias("id"), F.to_json(feature, _KEEP_NULLS).alias("feature")
    )


def story_features(stories: DataFrame) -> DataFrame:
    """(id, feature) of stories; lists are never NULL."""
    properties = F.struct(
        F.col("story_id").alias("id"), "summary", "member_count", "total_articles",
        "total_sources",
        F.least(F.lit(1.0), "intensity").alias("intensity"),
        "avg_tone", "trend", "articles_last_hour", "articles_prev_hour", "location",
        "country_code",
        F.coalesce("source_urls", F.array().cast("array<string>")).alias("source_urls"),
        F.coalesce("event_ids", F.array().cast("array<bigint>")).alias("event_ids"),
        iso_utc(F.col("earliest")).alias("earliest"),
        iso_utc(F.col("latest")).alias("latest"),
        iso_utc(F.col("run_at")).alias("run_at"),
    )
    feature = _feature(F.col("lon"), F.col("lat"), properties)
    return stories.select(
        F.col("story_id").alias("id"), F.to_json(feature, _KEEP_NULLS).alias("feature")
    )


def feature_collection(ranked: DataFrame, order: str = "rank") -> DataFrame:
    """One row with the whole collection. Only for results already cut to an API limit."""
    features = F.transform(
        F.array_sort(F.collect_list(F.struct(order, "feature"))), lambda f: f["feature"]
    )
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}")
    )
    return ranked.agg(text.alias("collection"))


def flatten_events(features: DataFrame) -> DataFrame:
    """Flat map points of event features (JSON text in ``feature``)."""
    schema = (
        "type string, geometry struct<type:string, coordinates:array<double>>, "
        f"properties struct<{_as_struct(EVENT_PROPERTIES)}>"
    )
    parsed = features.select(F.from_json("feature", schema).alias("f"))
    coordinates = F.col("f.geometry.coordinates")
    return parsed.select(
        F.get(coordinates, F.lit(0)).alias("lng"), F.get(coordinates, F.lit(1)).alias("lat"),
        "f.properties.*",
    )


def flatten_stories(features: DataFrame) -> DataFrame:
    """Flat map points of story features with the names events use."""
    schema = (
        "type string, geometry struct<type:string, coordinates:array<double>>, "
        f"properties struct<{_as_struct(STORY_PROPERTIES)}>"
    )
    parsed = features.select(F.from_json("feature", schema).alias("f"))
    coordinates, p = F.col("f.geometry.coordinates"), "f.properties"
    return parsed.select(
        F.get(coordinates, F.lit(0)).alias("lng"), F.get(coordinates, F.lit(1)).alias("lat"),
        F.col(f"{p}.summary").alias("title"),
        F.col(f"{p}.total_articles").alias("num_articles"),
        F.col(f"{p}.total_sources").alias("num_sources"),
        F.col(f"{p}.latest").alias("date_added"),
        F.get(F.col(f"{p}.source_urls"), F.lit(0)).alias("source_url"),
        f"{p}.*",
    )


def explode_collection(collections: DataFrame) -> DataFrame:
    """(feature) rows of FeatureCollection texts in ``collection``."""
    features = F.from_json(F.get_json_object("collection", "$.features"), "array<string>")
    return collections.select(F.explode(features).alias("feature"))


def _as_struct(ddl: str) -> str:
    return ", ".join(field.strip().replace(" ", ":", 1) for field in ddl.split(","))
