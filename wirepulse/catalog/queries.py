"""Every registered query: a library operator applied to the driver's tables.

Only the last ``select`` of a query is presentation: doubles are rounded, times and lists become
text, so results compare with plain SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepulse.catalog import inputs, tables
from wirepulse.functions import text
from wirepulse.functions.embedding import hashed_words, word_counts
from wirepulse.functions.geo import detect_country
from wirepulse.functions.timegrid import month_key
from wirepulse.operators import events as ev
from wirepulse.operators import geojson, grid, metrics, quality, replay, requests, retrieval
from wirepulse.operators import rollup, search, similarity
from wirepulse.operators import stories as st
from wirepulse.operators import validate
from wirepulse.operators.clean import clean, score, stage
from wirepulse.plans.ingest import ingest
from wirepulse.plans.retention import create_landing_table, run_retention
from wirepulse.plans.scored_layer import ScoredLayer
from wirepulse.plans.story_job import inline_event_ids
from wirepulse.schemas import EVENT_COLUMNS
from wirepulse.session import SHUFFLE_CLEANUP, fresh_path, settings
from wirepulse.sources import json_lines, landing, text_files
from wirepulse.sources.event_export import classify_lines, good_rows, reject_counts
from wirepulse.sources.title_export import parse_titles
from wirepulse.streaming.ingest import start_ingest
from wirepulse.streaming.rates import read_counts, start_counts
from wirepulse.streaming.titled import start_titled_ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RETENTION_AS_OF = "2024-03-01 00:00:00"


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _r6(column: str) -> Column:
    return F.round(column, 6).alias(column)


def _txt(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def _list(column: str, sep: str = "|") -> Column:
    items = F.transform(F.col(column), lambda x: x.cast("string"))
    return F.array_join(items, sep).alias(column)


def _event_columns(df: DataFrame, *extra: str) -> DataFrame:
    shown = {"event_date": _txt, "date_added": _txt, "avg_tone": _r6, "lat": _r6, "lon": _r6}
    return df.select(*extra, *[shown.get(c, F.col)(c) for c in EVENT_COLUMNS])


# --- parsing and validation -------------------------------------------------------------------


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_lines(inputs.event_lines(spark, sf_dir))


@register
def zip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export lines zipped into files, read back from the files."""
    folder = fresh_path(spark, "zips")
    lines = inputs.event_lines(spark, sf_dir).select(F.col("cycle").alias("path"), "value")
    written = text_files.write_zips(text_files.zip_lines(lines), folder)
    written.write.parquet(fresh_path(spark, "zip-names"))
    unpacked = text_files.read_zipped_lines(spark, folder)
    cycle = F.regexp_extract("cycle", r"([^/]*)\.[0-9a-f]{32}\.zip$", 1)
    return unpacked.groupBy(cycle.alias("cycle")).agg(
        F.count("*").alias("lines"),
        F.sum(F.length("value")).alias("chars"),
        F.min(F.md5("value")).alias("first_digest"),
        F.max(F.md5("value")).alias("last_digest"),
    )


@register
def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = good_rows(_classified(spark, sf_dir)).drop("page_title")
    return _event_columns(good.withColumn("page_title", F.lit(None)), "cycle", "line_no").drop("page_title")


@register
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).filter("reason is not null").select("cycle", "line_no", "reason")


@register
def parse_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_counts(_classified(spark, sf_dir))


@register
def gkg_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_titles(inputs.title_lines(spark, sf_dir))


@register
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = validate.validate_batch(good_rows(_classified(spark, sf_dir)))
    return _event_columns(valid, "cycle", "line_no").drop("page_title")


@register
def validation_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.drop_counts(good_rows(_classified(spark, sf_dir)))


@register
def title_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = parse_titles(inputs.title_lines(spark, sf_dir))
    _, loaded = ingest(inputs.event_lines(spark, sf_dir), titles)
    return loaded.select(
        "cycle", "line_no", "global_event_id", "source_url", "page_title"
    )


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = parse_titles(inputs.title_lines(spark, sf_dir))
    runs = metrics.run_metrics(_classified(spark, sf_dir), titles)
    return runs.withColumn("run_at", F.to_timestamp_ntz("cycle"))


def _run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored log of the runs, written once a session."""

    def write(path: str) -> None:
        metrics.append_run(_runs(spark, sf_dir), path, "export")

    return metrics.read_runs(spark, tables.stored(spark, sf_dir, "run_log", write))


def _drops_text(column: str) -> Column:
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    ).alias(column)


@register
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(
        "cycle", "rows_fetched", "rows_parsed", "rows_rejected", "rows_loaded", "titles_matched",
        _drops_text("parse_drops"), _drops_text("validation_drops"),
    )


@register
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.recent_runs(_run_log(spark, sf_dir), 20).select(
        _txt("run_at"), "rows_fetched", "rows_parsed", "rows_rejected", "rows_loaded", "titles_matched"
    )


@register
def cycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cycle_counts(inputs.raw_events(spark, sf_dir, titles=False))


@register
def missing_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.missing_cycles(inputs.raw_events(spark, sf_dir, titles=False))


@register
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = validate.validate_batch(good_rows(_classified(spark, sf_dir)))
    path = fresh_path(spark, "jsonl")
    json_lines.write_events(valid, path)
    return _event_columns(json_lines.read_events(spark, path)).drop("page_title")


# --- landing table ----------------------------------------------------------------------------


def _upsert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows, and a later load of some of them with other values and without title."""
    raw = inputs.raw_events(spark, sf_dir)
    again = raw.filter("quad_class = 2").withColumns(
        {
            "num_articles": F.col("num_articles") + 5,
            "num_mentions": F.col("num_mentions") * 2,
            "actor1_name": F.lit("LATER"),
            "page_title": F.when(F.col("num_mentions") % 2 == 0, F.col("page_title")),
            "load_seq": F.col("load_seq") + 1_000_000_000,
        }
    )
    return raw.unionByName(again)


@register
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = landing.merge_log(_upsert_log(spark, sf_dir))
    return _event_columns(merged, "load_seq", "month")


@register
def landing_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a year of rows as one load, folded into monthly bases; then a later load of some rows of the
    last months, merged with them when the current rows are read."""
    path = fresh_path(spark, "compacted-log")
    history = inputs.history_events(spark, sf_dir)
    again = history.filter("quad_class = 2 and date_added >= timestamp_ntz '2023-12-01 00:00:00'").withColumns(
        {"num_articles": F.col("num_articles") + 5, "actor1_name": F.lit("LATER"), "avg_tone": F.lit(None).cast("double")}
    )
    for number, rows in enumerate((history, again)):
        landing.append_batch(landing.to_landing_rows(rows, number, F.col("ingested_at")), path)
        if number == 0:
            landing.compact_log(spark, path)
    return _event_columns(landing.read_current(spark, path), "month")


@register
def scored_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored layer after two loads: half a year of rows, then some of the later ones again, of which
    every other one moved on by a month."""
    log, path = fresh_path(spark, "scored-log"), fresh_path(spark, "scored-layer")
    history = inputs.history_events(spark, sf_dir)
    moved = F.when(F.col("load_seq") % 2 == 0, F.make_dt_interval(days=F.lit(31))).otherwise(F.make_dt_interval())
    again = history.filter("quad_class = 2 and date_added >= timestamp_ntz '2023-12-01 00:00:00'").withColumns(
        {"num_articles": F.col("num_articles") + 5, "date_added": F.col("date_added") + moved}
    )
    layer = ScoredLayer(spark, path)
    for number, rows in enumerate((history, again)):
        ingested_at = F.lit(f"2024-02-0{number + 1}").cast("timestamp_ntz")
        landing.append_batch(landing.to_landing_rows(rows, number, ingested_at), log)
        layer.refresh(log)
    return layer.read("2024-02-01 00:00:00").select(
        "global_event_id", "month", _txt("date_added"), "num_articles", "num_sources", "load_seq", _r6("intensity")
    )


@register
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    partitions = landing.list_partitions(inputs.history_events(spark, sf_dir))
    return partitions.select("name", _txt("lower"), _txt("upper"), "rows")


@register
def landing_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last event time, between which a migration makes its months."""
    return landing.bounds(inputs.history_events(spark, sf_dir)).select(_txt("lo"), _txt("hi"))


@register
def repartition_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "monthly")
    landing.write_monthly(landing.to_monthly(inputs.history_events(spark, sf_dir)), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(_txt("month")).agg(
        F.count("*").alias("rows"),
        F.min("global_event_id").alias("min_id"),
        F.max("global_event_id").alias("max_id"),
        F.sum("num_mentions").alias("mentions"),
    )


def _valid_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = inputs.history_events(spark, sf_dir)
    return history.filter(validate.rule_reason().isNull())


def _rollup_text(df: DataFrame) -> DataFrame:
    return df.select(
        _txt("day"), "cell_lat", "cell_lon", "event_root_code", _r6("rep_lat"), _r6("rep_lon"),
        "event_count", "total_articles", "total_sources", _r6("avg_tone"),
    )


@register
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup_text(rollup.daily_rollup(_valid_history(spark, sf_dir)))


@register
def rollup_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _valid_history(spark, sf_dir)
    existing = rollup.daily_rollup(history.filter("date_added < timestamp_ntz '2023-11-01 00:00:00'"))
    return _rollup_text(rollup.insert_absent(existing, rollup.daily_rollup(history)))


@register
def expired_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    partitions = landing.list_partitions(inputs.history_events(spark, sf_dir))
    expired = rollup.expired_partitions(partitions, RETENTION_AS_OF)
    return expired.select("name", _txt("lower"), _txt("upper"), "rows")


@register
def retention_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    expired = rollup.expired_rows(_valid_history(spark, sf_dir), RETENTION_AS_OF)
    return _rollup_text(rollup.daily_rollup(expired))


@register
def retained_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rollup.retained_rows(_valid_history(spark, sf_dir), RETENTION_AS_OF)
    return kept.select("load_seq", "global_event_id", _txt("date_added"), "event_root_code")


@register
def retention_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads as a landing table; a run rolls expired months up and drops them, a second finds nothing
    more to do. What is left of both layers, by month."""
    raw, rolled = (f"{name}_{uuid.uuid4().hex}" for name in ("landed", "rolled"))
    load = F.col("quad_class") % 2
    create_landing_table(landing.to_landing_rows(_valid_history(spark, sf_dir), load, F.col("ingested_at")), raw)
    for _ in range(2):
        run_retention(spark, raw, rolled, RETENTION_AS_OF)
    left = spark.table(raw).groupBy(F.lit("raw").alias("layer"), "month", F.col("load_seq").cast("long").alias("load")).agg(
        F.count("*").alias("rows"), F.count("*").alias("events"), F.sum("num_articles").alias("articles")
    )
    month = month_key(F.col("day")).alias("month")
    days = spark.table(rolled).groupBy(F.lit("rollup").alias("layer"), month, F.lit(None).cast("long").alias("load")).agg(
        F.count("*").alias("rows"), F.sum("event_count").alias("events"), F.sum("total_articles").alias("articles")
    )
    out = fresh_path(spark, "retention-run")
    left.unionByName(days).write.parquet(out)
    for name in (raw, rolled):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.read.parquet(out)


# --- cleaned and scored layers, event queries -------------------------------------------------


@register
def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_columns(clean(inputs.raw_events(spark, sf_dir)))


@register
def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.raw_events(spark, sf_dir, titles=False)
    return score(clean(raw), inputs.newest(spark, sf_dir)).select(
        "global_event_id", _txt("date_added"), "num_articles", "num_sources", _r6("intensity"),
        _txt("scored_at"),
    )


def _hits(df: DataFrame) -> DataFrame:
    return df.select(
        "global_event_id", _txt("date_added"), "event_root_code", "lat", "lon", _r6("intensity")
    )


@register
def events_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(ev.bbox_filter(tables.scored_events(spark, sf_dir), -10.5, 35.0, 30.0, 60.0))


@register
def events_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = tables.scored_events(spark, sf_dir)
    return _hits(ev.time_filter(scored, "2024-01-10 06:00:00", "2024-01-12 18:30:00"))


@register
def events_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(ev.category_filter(tables.scored_events(spark, sf_dir), ["04", "14"]))


@register
def events_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(ev.category_filter(tables.scored_events(spark, sf_dir), ["04"], ["protest", "conflict"]))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select(
        "global_event_id", _txt("date_added"), "event_root_code", "page_title", "lat", "lon",
        _r6("effective_intensity"),
    )


@register
def events_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(ev.query_events(tables.scored_events(spark, sf_dir), limit=500))


@register
def events_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(
        ev.query_events(
            tables.scored_events(spark, sf_dir),
            bbox=(-120.0, -50.0, 120.0, 70.0),
            end="2024-01-15 12:00:00",
            themes=["diplomacy", "coercion"],
            at="2024-01-15 12:00:00",
            limit=500,
        )
    )


def _top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ev.query_events(tables.scored_events(spark, sf_dir), limit=500)
    return geojson.event_features(top.withColumn("effective_intensity", F.round("effective_intensity", 6)))


@register
def events_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_features(spark, sf_dir)


@register
def geojson_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geojson.flatten_events(_top_features(spark, sf_dir))


@register
def display_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = text.display_title(
        F.col("page_title"), F.col("actor1_name"), F.col("actor2_name"), F.col("global_event_id")
    )
    return tables.scored_events(spark, sf_dir).select(
        "global_event_id", title.alias("label"), text.buzz(F.round("intensity", 9)).alias("buzz")
    )


@register
def zoom_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.scored_events(spark, sf_dir).select(
        F.col("global_event_id").alias("id"), "lat", "lon",
        "intensity", "num_articles", "num_sources",
    )
    return grid.zoom_grid(points).select(
        "cell_deg", "cell_lat", "cell_lon", "id", "lat", "lon", _r6("intensity"), "num_articles",
        "num_sources", "cluster_size",
    )


@register
def markers_at_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the map shows from four camera altitudes; from the nearest the events themselves."""
    points = tables.scored_events(spark, sf_dir).select(
        F.col("global_event_id").alias("id"), "lat", "lon", "intensity",
        F.col("num_articles").cast("bigint").alias("num_articles"), F.col("num_sources").cast("bigint").alias("num_sources"),
    )
    shown = [grid.markers_at(points, a).withColumn("altitude", F.lit(a)) for a in (2.5, 1.5, 0.9, 0.5)]
    every = reduce(DataFrame.unionByName, shown)
    return every.select("altitude", "id", "lat", "lon", _r6("intensity"), "num_articles", "num_sources", "cluster_size")


@register
def slider_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = replay.slider_replay(tables.scored_events(spark, sf_dir), inputs.newest(spark, sf_dir))
    return shown.select(_txt("tick"), "rank", "global_event_id", _r6("effective_intensity"))


@register
def slider_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = replay.slider_counts(tables.scored_events(spark, sf_dir))
    return counts.select(_txt("tick"), "events", "articles")


@register
def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = tables.scored_events(spark, sf_dir)
    events = scored.withColumn("effective_intensity", F.round("intensity", 9))
    return search.place_search(events, ["united", "in", "FRANCE", "region 3", "east", "x"])


@register
def place_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each different word of all page titles and of all event places, and for the first three
    letters of each."""
    scored = tables.scored_events(spark, sf_dir)
    texts = inputs.pages_with_titles(spark, sf_dir).select(F.col("page_title").alias("t")).union(
        scored.select("action_geo_full_name")
    ).distinct()
    words = texts.select(F.explode(F.split(F.lower("t"), "[^a-z0-9]+")).alias("term")).distinct()
    terms = words.union(words.select(F.left("term", F.lit(3))))
    return search.search_places(scored.withColumn("effective_intensity", F.round("intensity", 9)), terms)


@register
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.raw_events(spark, sf_dir, titles=False)
    return quality.quality_report(raw, stage(raw), clean(raw), tables.scored_events(spark, sf_dir))


@register
def dq_intensity_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.intensity_out_of_range(tables.scored_events(spark, sf_dir))


# --- map requests -----------------------------------------------------------------------------


@register
def request_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = requests.validate_requests(inputs.map_requests(spark, sf_dir))
    return checked.select("request_id", "reason")


@register
def request_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all suppliers and their repeats by the same nation and window."""
    wanted = inputs.map_requests(spark, sf_dir)
    repeats = wanted.withColumn("request_id", F.col("request_id") + 1_000_000)
    both = wanted.unionByName(repeats).withColumn("start", F.lit(None).cast("timestamp_ntz"))
    return requests.dedupe_requests(both).select("request_id", "copies")


@register
def batch_viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = requests.validate_requests(inputs.map_requests(spark, sf_dir)).filter("reason is null")
    # A request without a box sees the whole map.
    world = {"west": -180.0, "south": -90.0, "east": 180.0, "north": 90.0}
    boxed = requests.with_codes(accepted).fillna(world, subset=list(world))
    answers = requests.answer_requests(boxed, tables.scored_events(spark, sf_dir))
    return answers.select("request_id", "rank", "global_event_id", _r6("effective_intensity"))


def _request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), "user_id", "ts"
    )


@register
def rate_limit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = metrics.rate_limit_audit(_request_log(spark, sf_dir), limit=3, window_seconds=86_400)
    return audit.select("user_id", _txt("window_start"), "requests", "rejected")


@register
def stream_user_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit from a stream's counts per user and window."""
    keys = {"user_id": "bigint"}
    stream = spark.readStream.schema(inputs.TABLE_SCHEMAS["events"]).parquet(f"{sf_dir}/[e]vents.parquet")
    out, state = fresh_path(spark, "user-rates"), fresh_path(spark, "state")
    start_counts(stream, "ts", "1 day", out, state, keys=keys).awaitTermination()
    audit = metrics.over_limit(read_counts(spark, out, keys), limit=3)
    return audit.select("user_id", _txt("window_start"), "requests", "rejected")


@register
def rate_limit_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = metrics.rejected_requests(_request_log(spark, sf_dir), limit=3, window_seconds=86_400)
    return rejected.select("request_id", "user_id", "retry_after")


# --- stories ----------------------------------------------------------------------------------


def _stories(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    """Labelled stories; one in three stories got no answer from the label generator."""
    plain = st.aggregate_stories(members, inputs.newest(spark, sf_dir), tables.WHOLE_TABLE)
    response = F.when(
        F.col("story_id") % 3 != 0, F.concat(F.lit(' "'), "rep_title", F.lit('."\nmore'))
    )
    return st.label_stories(plain, plain.select("story_id", response.alias("response")), tables.WHOLE_TABLE)


@register
def embed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pages_with_titles(spark, sf_dir).filter("page_title is not null").select(
        "page_id", F.array_join(word_counts(F.col("page_title")), ",").alias("buckets")
    )


@register
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return similarity.similarity_summary(vectors, 0.4)


@register
def story_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.story_input(tables.scored_events(spark, sf_dir), inputs.newest(spark, sf_dir))
    return rows.select("global_event_id", _txt("date_added"), "page_title")


@register
def story_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.story_members(spark, sf_dir).select("global_event_id", "story_id")


def _story_columns(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        *extra, "rep_title", "rep_url", "lat", "lon", "member_count", "total_articles",
        "total_sources", _r6("intensity"), _r6("avg_tone"), "trend", "articles_last_hour",
        "articles_prev_hour", _list("source_urls"), "location", "country_code", _txt("earliest"),
        _txt("latest"),
    )


@register
def story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = st.aggregate_stories(tables.story_members(spark, sf_dir), inputs.newest(spark, sf_dir), tables.WHOLE_TABLE)
    return _story_columns(stories, "story_id")


@register
def story_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.story_event_ids(tables.story_members(spark, sf_dir))


@register
def story_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stories(spark, sf_dir, tables.story_members(spark, sf_dir)).select(
        "story_id", "member_count", "label", "summary"
    )


@register
def story_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.story_metrics(_stories(spark, sf_dir, tables.story_members(spark, sf_dir)))


@register
def story_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = tables.story_members(spark, sf_dir)
    ids = st.document_ids(st.story_event_ids(members))
    return st.story_documents(_stories(spark, sf_dir, members), ids)


@register
def label_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.label_prompts(tables.story_members(spark, sf_dir))


@register
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator answers in several shapes around the page titles."""
    shape = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('  "'), "page_title", F.lit('"  ')))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("'"), "page_title", F.lit("..\nrest")))
        .when(F.col("page_id") % 5 == 2, F.lit("  \n "))
        .when(F.col("page_id") % 5 == 3, F.concat("page_title", F.lit("\n"), "page_title"))
        .otherwise(F.concat(F.lit('"\''), "page_title", F.lit('.\'"')))
    )
    return inputs.pages_with_titles(spark, sf_dir).select(
        "page_id", text.clean_label(shape).alias("label")
    )


@register
def story_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_at = F.date_trunc("day", "date_added").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(1))
    events = tables.scored_events(spark, sf_dir).withColumn("run_at", run_at)
    trend = st.story_trend(events, F.col("run_at"), "run_at", "action_geo_country_code")
    return trend.select(
        _txt("run_at"), "action_geo_country_code", "articles_last_hour", "articles_prev_hour", "trend"
    )


@register
def stories_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = ev.rank_stories(tables.story_store(spark, sf_dir).latest(), 500)
    return _story_columns(stories, "story_id", "summary")


@register
def stories_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest stories as features with their event ids, flattened again to map points."""
    store = tables.story_store(spark, sf_dir)
    full = inline_event_ids(ev.rank_stories(store.latest(), 500), store.latest_members())
    rounded = full.withColumns({"intensity": F.round("intensity", 6), "avg_tone": F.round("avg_tone", 6)})
    points = geojson.flatten_stories(geojson.story_features(rounded))
    return points.select(
        "id", "lng", "lat", "title", "num_articles", "num_sources", "date_added", "source_url",
        "summary", "member_count", "intensity", "avg_tone", "trend", "location", "country_code",
        _list("source_urls"), _list("event_ids", ","), "earliest", "run_at",
    )


@register
def story_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that are left after the newest one dropped those past their retention."""
    kept = tables.story_store(spark, sf_dir).stories()
    return kept.select(_txt("run_at"), "story_id", "member_count")


@register
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ev.pipeline_stats(
        tables.scored_events(spark, sf_dir), tables.story_store(spark, sf_dir).latest(), _run_log(spark, sf_dir)
    )
    return stats.select("total_events", "total_stories", _txt("last_ingestion_at"), "last_ingestion_rows")


@register
def stories_or_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map points before and after the first story run: no story yet, then the newest stories."""
    store = tables.story_store(spark, sf_dir)
    events = tables.scored_events(spark, sf_dir)

    def points(known: DataFrame, moment: str) -> DataFrame:
        shown = ev.stories_or_events(known, events).withColumn("intensity", F.round("intensity", 6))
        return shown.select(F.lit(moment).alias("moment"), "*")

    before = ev.rank_stories(store.latest(until=datetime(2024, 1, 1)), 800)
    return points(before, "before").unionByName(points(ev.rank_stories(store.latest(), 800), "after"))


# --- retrieval --------------------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = inputs.articles(spark, sf_dir).withColumn(
        "document", text.document_text(F.col("title"), F.col("summary"))
    )
    return retrieval.index_articles(entries, hashed_words)


def _prepared_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.embed_questions(inputs.questions(spark, sf_dir), hashed_words)


def _nearest(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("question_id", *extra, "rank", "id", "similarity")


@register
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = inputs.articles(spark, sf_dir)
    again = entries.filter("load_seq % 7 = 0").withColumns(
        {"summary": F.concat(F.lit("Updated: "), "title"), "load_seq": F.col("load_seq") + 1_000_000_000}
    )
    current = retrieval.upsert_index(entries.unionByName(again))
    return current.select(
        "id", "title", "summary", "load_seq",
        text.document_text(F.col("title"), F.col("summary")).alias("document"),
    )


@register
def detect_country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.questions(spark, sf_dir).select(
        "question_id", detect_country(F.col("question")).alias("country")
    )


@register
def knn_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unscoped neighbours of every labelled vector among all of the table; it is its own nearest."""
    vectors = inputs.table(spark, sf_dir, "embeddings")
    dense = F.col("embedding").cast("array<double>")
    asked = vectors.select(
        F.col("vec_id").alias("question_id"), dense.alias("vector"), F.lit(None).cast("string").alias("country")
    )
    index = vectors.select(
        F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("id"), dense.alias("embedding"),
        F.col("label").cast("string").alias("country_code"),
    )
    return _nearest(retrieval.nearest_entries(asked, index))


@register
def knn_country_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    nearest = retrieval.nearest_with_fallback(_prepared_questions(spark, sf_dir), _index(spark, sf_dir))
    return _nearest(nearest, "scoped")


@register
def rag_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = retrieval.answer_questions(
        inputs.questions(spark, sf_dir), _index(spark, sf_dir), hashed_words
    )
    sources = F.transform("sources", lambda s: F.concat_ws(" ", s["title"], s["source_url"]))
    return answers.select(
        "question_id", "prompt", F.array_join(sources, "|").alias("sources")
    )


# --- streaming --------------------------------------------------------------------------------


@register
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export files in one folder per cycle, ingested as a stream, read from the landing log."""
    files, out, state = (fresh_path(spark, n) for n in ("lines", "landing", "state"))
    # Files hold consecutive lines and are named in that order, so a large cycle may be split.
    inputs.event_lines(spark, sf_dir).repartitionByRange("cycle", "line_no").sortWithinPartitions(
        "cycle", "line_no"
    ).select("cycle", "value").write.partitionBy("cycle").text(files)
    titles = lambda: parse_titles(inputs.title_lines(spark, sf_dir))
    start_ingest(spark, files, out, state, titles).awaitTermination()
    current = landing.merge_log(landing.read_log(spark, out))
    return _event_columns(current, "month")


@register
def stream_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and titles as two streams, joined by cycle and URL, read from the landing log. All files are
    there at the start, so no cycle has to wait for late ones."""
    lines, titles, out, state = (fresh_path(spark, n) for n in ("lines", "titles", "landing", "state"))
    with settings(spark, SHUFFLE_CLEANUP):
        for rows, path in ((inputs.event_lines, lines), (inputs.cycle_title_lines, titles)):
            rows(spark, sf_dir).repartitionByRange("cycle", "line_no").sortWithinPartitions("cycle", "line_no").select(
                "cycle", "value"
            ).write.partitionBy("cycle").text(path, compression="gzip")
    start_titled_ingest(spark, lines, titles, out, state, delay="0 seconds").awaitTermination()
    return landing.read_log(spark, out).select("cycle", "global_event_id", "num_articles", "source_url", "page_title")


@register
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = inputs.TABLE_SCHEMAS["events"]
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    out, state = fresh_path(spark, "rates"), fresh_path(spark, "state")
    start_counts(stream, "ts", "1 hour", out, state).awaitTermination()
    return read_counts(spark, out).select(_txt("window_start"), "events")
