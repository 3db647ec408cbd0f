import datetime as dt

import pytest
from pyspark.sql import functions as F

from wirepulse.functions.scoring import intensity, normalized_count, recency_decay
from wirepulse.operators.clean import clean
from wirepulse.operators.validate import drop_counts, validate_batch
from wirepulse.params import ScoreParams
from wirepulse.schemas import EVENT_SCHEMA

T = dt.datetime(2026, 7, 4, 12)


def event(event_id=1, **changes):
    base = dict(
        global_event_id=event_id, event_date=T, date_added=T, actor1_name=None, actor2_name=None,
        event_code="042", event_root_code="04", quad_class=1, num_mentions=10, num_sources=3,
        num_articles=5, avg_tone=-1.0, action_geo_full_name=None, action_geo_country_code=None,
        lat=48.8, lon=2.3, source_url=None, page_title=None,
    )
    return {**base, **changes}


def batch(spark, rows):
    schema = EVENT_SCHEMA + ", cycle string, line_no bigint, ingested_at timestamp_ntz, load_seq bigint"
    full = [
        {"cycle": "c", "line_no": i, "ingested_at": T, "load_seq": i, **r} for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, schema)


def test_rules_and_drop_counts(spark):
    rows = [
        event(1), event(2, lat=None), event(3, lon=None), event(4, lat=95.0), event(5, lon=-181.0),
        event(6, lat=-91.0), event(7, lat=0.0, lon=0.0), event(8, num_articles=-1),
        event(9, num_mentions=None, num_sources=None, num_articles=None), event(10, event_code=""),
        event(11, lat=float("nan")), event(42), event(42, num_articles=99),
    ]
    df = batch(spark, rows)
    valid = {r.global_event_id: r.num_articles for r in validate_batch(df).collect()}
    assert valid == {1: 5, 9: None, 42: 99}
    assert {r.reason: r.rows for r in drop_counts(df).collect()} == {
        "invalid_coordinates": 7, "negative_counts": 1, "missing_event_code": 1,
        "duplicate_event_id_in_batch": 1,
    }


def test_bad_rows_do_not_take_part_in_duplicates(spark):
    df = batch(spark, [event(1, num_articles=3), event(1, lat=95.0)])
    assert [r.num_articles for r in validate_batch(df).collect()] == [3]
    assert {r.reason for r in drop_counts(df).collect()} == {"invalid_coordinates"}


def test_clean_takes_latest_first_then_rules(spark):
    later = T + dt.timedelta(hours=1)
    df = batch(spark, [
        event(1), event(1, date_added=later, lat=95.0),
        event(2, num_articles=1), event(2, date_added=later, num_articles=2),
        event(3, event_root_code="04\n"), event(4, event_root_code="21"), event(5, event_root_code=None),
    ])
    assert {r.global_event_id: r.num_articles for r in clean(df).collect()} == {2: 2}


def test_latest_per_id_limits_before_the_shuffle(spark):
    plan = clean(batch(spark, [event(1)]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.index("Exchange")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("count, expected", [(0, 0.0), (None, 0.0), (-5, 0.0), (100, 1.0), (10000, 1.0)])
def test_normalized_count(spark, count, expected):
    assert value(spark, normalized_count(F.lit(count).cast("int"), 100)) == pytest.approx(expected)


@pytest.mark.parametrize("hours, expected", [(0, 1.0), (6, 0.5), (12, 0.25), (-3, 1.0)])
def test_recency(spark, hours, expected):
    then = F.lit(str(T - dt.timedelta(hours=hours))).cast("timestamp_ntz")
    now = F.lit(str(T)).cast("timestamp_ntz")
    assert value(spark, recency_decay(then, now, 6)) == pytest.approx(expected)


def test_score_bounds_and_errors(spark):
    row = lambda a, s: spark.createDataFrame(
        [(a, s, T)], "num_articles int, num_sources int, date_added timestamp_ntz"
    ).select(intensity(T).alias("v")).first().v
    assert row(1000, 1000) == pytest.approx(1.0)
    assert row(None, None) == pytest.approx(0.3)
    with pytest.raises(ValueError):
        normalized_count(F.lit(1), 0)
    with pytest.raises(ValueError):
        recency_decay(F.lit(None), F.lit(None), 0)


def test_score_params_from_env(monkeypatch):
    monkeypatch.setenv("INTENSITY_HALF_LIFE_HOURS", "12")
    assert ScoreParams.from_env().half_life_hours == 12.0
    assert ScoreParams.from_env().w_articles == 0.4
