"""Declared schemas; nothing is inferred from files."""

from __future__ import annotations

# Columns of a parsed event, in order.
EVENT_COLUMNS = [
    "global_event_id", "event_date", "date_added", "actor1_name", "actor2_name", "event_code",
    "event_root_code", "quad_class", "num_mentions", "num_sources", "num_articles", "avg_tone",
    "action_geo_full_name", "action_geo_country_code", "lat", "lon", "source_url", "page_title",
]

# A re-emitted event replaces these five columns; all others stay as first written.
VOLATILE_COLUMNS = ["num_mentions", "num_sources", "num_articles", "avg_tone", "page_title"]
KEY_COLUMNS = ["global_event_id", "date_added"]
STABLE_COLUMNS = [c for c in EVENT_COLUMNS if c not in VOLATILE_COLUMNS + KEY_COLUMNS]

EVENT_SCHEMA = (
    "global_event_id bigint, event_date timestamp_ntz, date_added timestamp_ntz, "
    "actor1_name string, actor2_name string, event_code string, event_root_code string, "
    "quad_class int, num_mentions int, num_sources int, num_articles int, avg_tone double, "
    "action_geo_full_name string, action_geo_country_code string, lat double, lon double, "
    "source_url string, page_title string"
)

# Columns of the scored table besides the event columns; ``month`` is its partition column.
SCORED_SCHEMA = EVENT_SCHEMA + (
    ", ingested_at timestamp_ntz, load_seq bigint, intensity double, scored_at timestamp_ntz, "
    "month string"
)

RUN_SCHEMA = (
    "run_at timestamp_ntz, source string, rows_fetched bigint, rows_parsed bigint, "
    "rows_rejected bigint, rows_loaded bigint, titles_matched bigint, "
    "parse_drops map<string,bigint>, validation_drops map<string,bigint>, duration_seconds double"
)
