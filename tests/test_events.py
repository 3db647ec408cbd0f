import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.test_validate_clean import batch, event
from wirepulse.dimensions import codes_for_themes
from wirepulse.operators import events as ev
from wirepulse.operators import geojson, grid, metrics, quality, replay, requests, search
from wirepulse.functions.scoring import intensity
from wirepulse.operators.clean import score, write_scored

NOON = dt.datetime(2026, 7, 4, 12)
EVENING = dt.datetime(2026, 7, 4, 18)


def scored(spark):
    rows = [
        event(1, lat=48.8566, lon=2.3522, event_root_code="04", date_added=NOON, page_title="Paris summit"),
        event(2, lat=35.6762, lon=139.6503, event_root_code="14", date_added=NOON, page_title="Tokyo protest"),
        event(3, lat=-33.8688, lon=151.2093, event_root_code="04", date_added=EVENING, page_title="Sydney talks"),
    ]
    rows = [{**r, "num_articles": 8} for r in rows]
    value = F.element_at(F.create_map(*[F.lit(x) for x in (1, 0.9, 2, 0.5, 3, 0.7)]), F.col("global_event_id").cast("int"))
    return batch(spark, rows).withColumn("intensity", value)


def ids(df):
    return [r.global_event_id for r in df.collect()]


@pytest.mark.parametrize("filters, expected", [
    ({}, [1, 3, 2]),
    ({"bbox": (-10, 35, 30, 60)}, [1]),
    ({"bbox": (30, 35, -10, 60)}, [1]),
    ({"start": "2026-07-04 15:00:00", "end": "2026-07-04 23:00:00"}, [3]),
    ({"start": NOON, "end": NOON}, [1, 2]),
    ({"categories": ["14"]}, [2]),
    ({"themes": ["protest"]}, [2]),
    ({"themes": ["protest"], "categories": ["04"]}, [1, 3, 2]),
    ({"at": EVENING, "categories": ["04"]}, [3, 1]),
    ({"limit": 1}, [1]),
])
def test_query_events(spark, filters, expected):
    assert ids(ev.query_events(scored(spark), **filters)) == expected


def test_unknown_theme():
    assert codes_for_themes(["protest", "cooperation"]) == ["06", "07", "08", "14"]
    with pytest.raises(KeyError):
        codes_for_themes(["sports"])


def test_top_k_plan_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "scored")
    write_scored(scored(spark), path)
    plan = ev.query_events(
        spark.read.parquet(path), bbox=(-10, 35, 30, 60), start=NOON, categories=["04"]
    )._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "lat" in pushed and "lon" in pushed and "month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def stories(spark):
    schema = "run_at timestamp_ntz, story_id bigint, summary string, lat double, lon double, intensity double, total_articles bigint"
    return spark.createDataFrame([
        (EVENING, 1, "New A", 1.0, 2.0, 1.2, 5), (EVENING, 2, "New B", 3.0, 4.0, 0.4, 6),
        (NOON, 3, "Stale", 5.0, 6.0, 2.0, 7),
    ], schema)


def runs(spark):
    rows = [(NOON, 800, 775), (EVENING, 900, 880)]
    return spark.createDataFrame(rows, "run_at timestamp_ntz, rows_fetched bigint, rows_loaded bigint")


def test_latest_stories_and_stats(spark):
    got = ev.query_stories(stories(spark)).collect()
    assert [(r.story_id, r.intensity) for r in got] == [(1, 1.0), (2, 0.4)]
    row = ev.pipeline_stats(scored(spark), stories(spark), runs(spark)).first()
    assert (row.total_events, row.total_stories, row.last_ingestion_rows) == (3, 2, 880)
    empty = ev.pipeline_stats(scored(spark).limit(0), stories(spark).limit(0), runs(spark).limit(0)).first()
    assert tuple(empty) == (0, 0, None, None)
    assert [r.rows_loaded for r in ev.recent_runs(runs(spark), 1).collect()] == [880]


def test_stories_or_events(spark):
    assert {r.kind for r in ev.stories_or_events(stories(spark), scored(spark)).collect()} == {"story"}
    none = ev.stories_or_events(stories(spark).limit(0), scored(spark)).collect()
    assert [(r.kind, r.id) for r in none] == [("event", 1), ("event", 3), ("event", 2)]


def test_geojson(spark):
    top = ev.query_events(scored(spark))
    features = geojson.event_features(top)
    first = json.loads(features.first().feature)
    assert first["geometry"] == {"type": "Point", "coordinates": [2.3522, 48.8566]}
    assert first["properties"]["title"] == "Paris summit" and first["properties"]["actor1"] is None
    assert first["properties"]["date_added"] == "2026-07-04T12:00:00+00:00"
    collection = geojson.feature_collection(features.withColumn("rank", F.col("id")))
    assert len(json.loads(collection.first().collection)["features"]) == 3
    flat = geojson.flatten_events(geojson.explode_collection(collection)).collect()
    assert [(r.id, r.lng, r.lat) for r in flat][0] == (1, 2.3522, 48.8566)


REQUEST = "request_id bigint, bbox string, start timestamp_ntz, end timestamp_ntz, at timestamp_ntz, categories array<string>, themes array<string>, limit int"


def request_rows(spark, *rows):
    base = dict(bbox=None, start=None, end=None, at=None, categories=None, themes=None, limit=500)
    return spark.createDataFrame([{**base, "request_id": i, **r} for i, r in enumerate(rows)], REQUEST)


@pytest.mark.parametrize("change, reason", [
    ({"bbox": "-10,35,30,60"}, None),
    ({"bbox": "1,2,3"}, "bbox_needs_four_numbers"),
    ({"bbox": "a,b,c,d"}, "bbox_not_numeric"),
    ({"bbox": "-200,35,30,60"}, "longitude_out_of_range"),
    ({"bbox": "-10,-95,30,60"}, "latitude_out_of_range"),
    ({"bbox": "nan,35,30,60"}, "longitude_out_of_range"),
    ({"bbox": "-10,70,30,60"}, "south_above_north"),
    ({"start": EVENING, "end": NOON}, "start_after_end"),
    *[({"categories": [c]}, "unknown_root_code") for c in ("0", "21", "99", "xx", "004")],
    ({"themes": ["sports"]}, "unknown_theme"),
    ({"limit": 0}, "limit_out_of_range"), ({"limit": 99999}, "limit_out_of_range"),
])
def test_request_checks(spark, change, reason):
    assert requests.validate_requests(request_rows(spark, change)).first().reason == reason


def test_fingerprint_covers_every_parameter_but_not_list_order(spark):
    base = dict(bbox="1,2,3,4", start=NOON, end=NOON, at=NOON, categories=["04"], themes=["protest"], limit=500)
    changes = [
        {}, {"bbox": "9,2,3,4"}, {"start": None}, {"end": None}, {"at": None}, {"categories": ["05"]},
        {"categories": None}, {"themes": ["conflict"]}, {"themes": None}, {"limit": 100},
    ]
    df = request_rows(spark, *[{**base, **c} for c in changes])
    assert requests.dedupe_requests(df).count() == len(changes)
    orders = request_rows(
        spark, {"categories": ["04", "14"], "themes": ["a", "b"]}, {"categories": ["14", "04"], "themes": ["b", "a"]}
    )
    assert [(r.request_id, r.copies) for r in requests.dedupe_requests(orders).collect()] == [(0, 2)]


def test_batch_answers_equal_single_queries(spark):
    asked = [
        {"bbox": "-10,35,30,60"}, {}, {"categories": ["14"]}, {"themes": ["protest"], "categories": ["04"]},
        {"at": EVENING, "categories": ["04"]}, {"limit": 1}, {"bbox": "-180,-90,180,90", "start": EVENING},
    ]
    checked = requests.with_codes(requests.validate_requests(request_rows(spark, *asked)))
    boxed = checked.fillna({"west": -180.0, "south": -90.0, "east": 180.0, "north": 90.0})
    answers = requests.answer_requests(boxed, scored(spark))
    got = {}
    for row in answers.orderBy("request_id", "rank").collect():
        got.setdefault(row.request_id, []).append(row.global_event_id)
    assert got == {0: [1], 1: [1, 3, 2], 2: [2], 3: [1, 3, 2], 4: [3, 1], 5: [1], 6: [3]}
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_slider_window_is_closed_on_both_ends(spark):
    shown = replay.slider_replay(scored(spark), EVENING, history_hours=12)
    at = lambda t: sorted(r.global_event_id for r in shown.filter(F.col("tick") == F.lit(str(t)).cast("timestamp_ntz")).collect())
    assert at(EVENING) == [1, 2, 3]
    assert at(NOON) == [1, 2]
    assert at(NOON - dt.timedelta(minutes=15)) == []
    counts = {str(r.tick): r.events for r in replay.slider_counts(scored(spark)).collect()}
    assert counts["2026-07-04 18:00:00"] == 3 and counts["2026-07-04 18:15:00"] == 1
    assert len(counts) == 49


def test_zoom_grid(spark):
    schema = "id bigint, lat double, lon double, intensity double, num_articles int, num_sources int"
    points = spark.createDataFrame([
        (1, 1.0, 1.0, 0.5, 5, None), (2, 1.5, 1.5, 0.9, None, 2), (3, 7.0, 7.0, 0.1, 1, 1),
        (4, -1.0, -1.0, 0.3, None, None),
    ], schema)
    cells = {(r.cell_deg, r.cell_lat): r for r in grid.zoom_grid(points).collect()}
    assert (cells[8, 0].id, cells[8, 0].cluster_size, cells[8, 0].num_articles, cells[8, 0].num_sources) == (2, 3, 6, 3)
    assert (cells[2, 0].id, cells[2, 0].cluster_size, cells[2, 0].num_articles) == (2, 2, 5)
    assert (cells[8, -1].id, cells[8, -1].cluster_size, cells[8, -1].num_articles) == (4, None, None)
    assert [grid.cell_size(a) for a in (2.5, 2.0, 1.2, 0.7, 0.6)] == [8, 8, 4, 2, 0]
    assert grid.markers_at(points, 0.5).count() == 4
    assert grid.markers_at(points, 2.5).count() == 2


def test_place_search(spark):
    named = scored(spark).withColumns({
        "effective_intensity": F.col("intensity"),
        "action_geo_full_name": F.concat(F.lit("Franceville "), F.col("global_event_id")),
    })
    got = search.place_search(named, [" fran ", "f", "united"]).orderBy("term", "position").collect()
    assert [(r.term, r.kind, r.name) for r in got] == [
        ("fran", "country", "France"), ("fran", "place", "Franceville 1"), ("fran", "place", "Franceville 3"),
        ("fran", "place", "Franceville 2"), ("united", "country", "United Arab Emirates"),
        ("united", "country", "United Kingdom"), ("united", "country", "United States"),
    ]


def test_rate_limit(spark):
    start = dt.datetime(2026, 7, 4, 12, 0, 30)
    rows = [(i, "u", start + dt.timedelta(seconds=i)) for i in range(12)] + [(99, "v", start)]
    log = spark.createDataFrame(rows, "request_id bigint, user_id string, ts timestamp_ntz")
    audit = metrics.rate_limit_audit(log).collect()
    assert [(r.user_id, r.requests, r.rejected) for r in audit] == [("u", 12, 2)]
    rejected = metrics.rejected_requests(log).orderBy("request_id").collect()
    assert [(r.request_id, r.retry_after) for r in rejected] == [(10, 20), (11, 19)]


def test_missing_cycles(spark):
    rows = [event(i, date_added=NOON + dt.timedelta(minutes=m)) for i, m in enumerate((1, 20, 61))]
    got = sorted(r.cycle for r in metrics.missing_cycles(batch(spark, rows)).collect())
    assert got == ["20260704123000", "20260704124500"]


def test_quality_report(spark):
    rows = batch(spark, [event(1), event(1), event(2, event_root_code="21", quad_class=7), event(3, lat=None)])
    got = {(r.column, r.check): r.failures for r in quality.check_table(rows, "t", quality.CLEANED_CHECKS).collect()}
    assert got["global_event_id", "unique"] == 1 and got["lat", "not_null"] == 1
    assert got["event_root_code", "accepted_values"] == 1 and got["quad_class", "accepted_values"] == 1
    total = sum(len(c) for c in (quality.SOURCE_CHECKS, quality.STAGING_CHECKS, quality.CLEANED_CHECKS, quality.SCORED_CHECKS))
    assert total == 18  # the range test is the nineteenth
    odd = scored(spark).withColumn("intensity", F.col("intensity") + 0.2)
    assert ids(quality.intensity_out_of_range(odd)) == [1]


def test_many_terms_find_what_each_finds_alone(spark):
    names = ["Paris, France", "Franeker", "Ran", "Rantoul", "united  place", "x", "", None]
    rows = [event(i, action_geo_full_name=n) for i, n in enumerate(names * 3)]
    named = batch(spark, rows).withColumn("effective_intensity", F.col("global_event_id") % 5 / 5)
    terms = [" fran ", "FRAN", "f", "united", "an", "rant", "zzz", "xyq", "", "a,"]
    got = search.search_places(named, spark.createDataFrame([(t,) for t in [*terms, None]], "term string"))
    want = search.place_search(named, terms)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    assert search.search_places(named.limit(0), spark.createDataFrame([], "term string")).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_exploded_requests_are_not_broadcast(spark):
    checked = requests.with_codes(requests.validate_requests(request_rows(spark, {"limit": 20}, {"limit": 3, "bbox": "2,2,9,9"})))
    boxed = checked.fillna({"west": -180.0, "south": -90.0, "east": 180.0, "north": 90.0})
    events = score(batch(spark, [event(i) for i in range(1, 9)]), EVENING)
    plan = requests.answer_requests(boxed, events)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_deg" in plan and "BroadcastHashJoin [_deg" not in plan


def test_pairs_of_requests_and_blocks_are_not_shuffled_to_be_judged(spark):
    """The score that a request is sure to reach comes to the requests, and events below it don't leave the join."""
    asked = [{"limit": 2}, {"limit": 3, "bbox": "-80,-80,80,80"}, {"limit": 400}, {"limit": 2, "at": NOON}]
    checked = requests.with_codes(requests.validate_requests(request_rows(spark, *asked)))
    boxed = checked.fillna({"west": -180.0, "south": -90.0, "east": 180.0, "north": 90.0})
    events = score(batch(spark, [event(i, lat=i % 9 - 4.0, num_articles=i % 101, num_sources=i % 26) for i in range(1, 300)]), EVENING)
    opened = requests.opened_blocks(boxed.select("request_id", "west", "south", "east", "north", "start", "end", "at", "codes", "limit"),
                                    requests.event_blocks(requests.event_points(events)))
    joins = [x for x in opened._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    assert "SortMergeJoin [_deg" in joins[0]  # the last one; nothing is joined to the pairs that met
    sure = {r.request_id: r._sure for r in opened.select("request_id", "_sure").distinct().collect()}
    assert sure[0] > 0.3 and sure[1] > 0.3 and sure[2] is None and sure[3] > 0.3
    answers = requests.answer_requests(boxed, events).collect()
    for request, limit in enumerate((2, 3, 299, 2)):
        got = [r for r in answers if r.request_id == request]
        assert len(got) == limit and all(r.effective_intensity >= (sure[request] or 0) - 1e-8 for r in got)


def test_whole_map_requests_open_few_blocks_and_lose_nothing(spark):
    rows = [
        event(i, lat=(i * 37 % 170) - 85.0, lon=(i * 53 % 350) - 175.0, event_root_code=f"{i % 20 + 1:02d}",
              num_articles=i * 7 % 101, num_sources=i * 3 % 26, date_added=NOON - dt.timedelta(hours=i * 11 % 300))
        for i in range(1, 1500)
    ]
    events = score(batch(spark, rows), EVENING)
    asked = [
        {"limit": 20}, {"limit": 20, "at": NOON - dt.timedelta(hours=90)}, {"limit": 5, "categories": ["04"]},
        {"limit": 7, "bbox": "-60,-30,80,70"}, {"limit": 5000}, {"limit": 3, "bbox": "2,2,9,9"},
        {"limit": 10, "start": NOON - dt.timedelta(hours=50), "end": NOON - dt.timedelta(hours=20)},
    ]
    checked = requests.with_codes(requests.validate_requests(request_rows(spark, *asked)))
    boxed = checked.fillna({"west": -180.0, "south": -90.0, "east": 180.0, "north": 90.0})
    got = {}
    for row in requests.answer_requests(boxed, events).orderBy("request_id", "rank").collect():
        got.setdefault(row.request_id, []).append(row.global_event_id)
    for r in boxed.collect():
        effective = intensity(r.at) if r.at else F.col("intensity")
        hits = ev.bbox_filter(ev.category_filter(ev.time_filter(events, r.start, r.end), r.codes), r.west, r.south, r.east, r.north)
        want = hits.orderBy(F.desc(F.round(effective, 9)), "global_event_id").limit(r.limit)
        assert got.get(r.request_id, []) == ids(want), r
    opened = requests.opened_blocks(boxed, requests.event_blocks(requests.event_points(events)))
    met = {r.request_id: r.n for r in opened.groupBy("request_id").agg(F.sum("events").alias("n")).collect()}
    assert met[0] < 150 and met[1] < 150 and met[4] == 1499  # of 1,499 events each
