import datetime as dt

from pyspark.sql import functions as F

from tests.test_validate_clean import batch, event
from wirepulse.operators.events import time_filter
from wirepulse.operators.rollup import daily_rollup, insert_absent
from wirepulse.plans.ingest import attach_titles
from wirepulse.plans.retention import create_landing_table, run_retention
from wirepulse.sources.loads import LoadManifest
from wirepulse.sources.landing import (
    append_batch, bounds, compact_log, list_partitions, merge_log, read_current, read_log, to_landing_rows, to_monthly,
    write_monthly,
)

NOW = dt.datetime(2026, 7, 5)
OLD = NOW - dt.timedelta(days=120)
RECENT = NOW - dt.timedelta(days=3)
HOUR = dt.timedelta(hours=1)


def landing_rows(spark):
    return batch(spark, [
        event(1, date_added=OLD, lat=10.0, lon=20.0, event_root_code="14", num_articles=5),
        event(2, date_added=OLD + 2 * HOUR, lat=10.5, lon=20.5, event_root_code="14", num_articles=7),
        event(3, date_added=OLD + 3 * HOUR, lat=10.4, lon=20.2, event_root_code="18", num_articles=4),
        event(4, date_added=RECENT, num_articles=12),
        event(5, date_added=RECENT + HOUR, num_articles=9),
    ])


def rows_for(spark, rows, seq):
    return to_landing_rows(batch(spark, rows), seq, F.lit("2026-07-05").cast("timestamp_ntz"))


def test_upsert_changes_volatile_columns_only_and_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "log")
    append_batch(rows_for(spark, [event(4, page_title="Old", actor1_name="A")], 0), path)
    later = [event(4, num_articles=99, actor1_name="B"), event(6)]
    for _ in range(2):  # the second write of the same batch is a retry
        append_batch(rows_for(spark, later, 1), path)
    got = {r.global_event_id: r for r in merge_log(read_log(spark, path)).collect()}
    assert set(got) == {4, 6} and read_log(spark, path).count() == 3
    assert got[4].num_articles == 99 and got[4].page_title is None and got[4].actor1_name == "A"


def test_compaction_keeps_the_result(spark, tmp_path):
    """Months with newer loads only are folded again; unfinished loads stay out; readers see all."""
    path = str(tmp_path / "log")
    manifest = LoadManifest(spark, path)
    current = lambda: sorted(map(str, read_current(spark, path).collect()))
    whole = lambda: sorted(map(str, merge_log(read_log(spark, path)).collect()))

    def add(rows, batch, finish=True):
        load = manifest.reserve("s", batch)
        append_batch(rows_for(spark, rows, load.number), path)
        if finish:
            manifest.finish(load)
        return load

    old = dict(date_added=OLD)
    add([event(4, page_title="Old", actor1_name="A"), event(5), event(7, **old), event(8, **old)], 0)
    assert compact_log(spark, path) == ["2026-03", "2026-07"] and compact_log(spark, path) == []
    add([event(4, num_articles=7, actor1_name="B"), event(9)], 1)
    assert current() == whole()
    late = add([event(7, num_articles=3, **old)], 2, finish=False)
    add([event(4, num_articles=9, actor1_name="C")], 3)
    assert compact_log(spark, path) == ["2026-07"]  # up to load 1: load 2 is still being written
    assert (tmp_path / "log/_base/month=2026-07/through=1").exists() and current() == whole()
    manifest.finish(late)
    assert compact_log(spark, path) == ["2026-03", "2026-07"] and current() == whole()
    got = {r.global_event_id: (r.num_articles, r.actor1_name, r.page_title) for r in read_current(spark, path).collect()}
    assert got[4] == (9, "A", None) and got[7][0] == 3 and len(got) == 5
    # The first base of July is gone, the one before the newest is still there.
    assert sorted(p.name for p in (tmp_path / "log/_base/month=2026-07").iterdir()) == ["through=1", "through=3"]
    (tmp_path / "log/_base/_done/3").unlink()  # a compaction that died before its end
    assert current() == whole()


def test_months_without_later_loads_are_only_scanned(spark, tmp_path):
    path = str(tmp_path / "log")
    append_batch(rows_for(spark, [event(1, date_added=OLD), event(2, date_added=OLD)], 0), path)
    compact_log(spark, path)
    plan = read_current(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    append_batch(rows_for(spark, [event(3)], 1), path)  # a month of its own
    assert read_current(spark, path, months=["2026-03"]).count() == 2 and read_current(spark, path).count() == 3
    compact_log(spark, path)
    append_batch(rows_for(spark, [event(3, num_articles=8)], 2), path)
    plan = read_current(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("+- Union"):].split("FileScan")[0]  # the scan of March
    assert {r.num_articles for r in read_current(spark, path).filter("global_event_id = 3").collect()} == {8}


def test_titles_join_within_the_cycle(spark):
    events = batch(spark, [event(1, source_url="u"), event(2), event(3, source_url="v")])
    titles = spark.createDataFrame([("c", "u", "T"), ("other", "v", "X")], "cycle string, url string, page_title string")
    got = {r.global_event_id: r.page_title for r in attach_titles(events, titles, "cycle").collect()}
    assert got == {1: "T", 2: None, 3: None}


def test_new_date_added_is_a_new_row(spark):
    log = rows_for(spark, [event(1), event(1, date_added=RECENT)], 0)
    assert merge_log(log).count() == 2


def test_months_are_pruned(spark, tmp_path):
    path = str(tmp_path / "monthly")
    write_monthly(to_monthly(landing_rows(spark)), path)
    recent = time_filter(spark.read.parquet(path), NOW - dt.timedelta(days=7))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "date_added" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert recent.count() == 2


def test_partition_list(spark):
    parts = list_partitions(landing_rows(spark)).collect()
    assert [(p.name, p.rows) for p in parts] == [("raw_events_y2026m03", 3), ("raw_events_y2026m07", 2)]
    assert str(parts[0].upper) == "2026-04-01 00:00:00"
    assert bounds(landing_rows(spark)).first().lo == OLD


def test_migration_ignores_duplicates(spark):
    twice = landing_rows(spark).unionByName(landing_rows(spark).withColumn("load_seq", F.col("load_seq") + 100))
    assert to_monthly(twice).count() == 5


def test_rollup_values_and_insert_absent(spark):
    rollup = daily_rollup(landing_rows(spark))
    old = {r.event_root_code: r for r in rollup.filter("day < date'2026-06-01'").collect()}
    assert (old["14"].cell_lat, old["14"].cell_lon, old["14"].event_count, old["14"].total_articles) == (5, 10, 2, 12)
    assert old["18"].event_count == 1
    assert insert_absent(rollup, rollup).count() == 0
    assert insert_absent(rollup.filter("event_root_code = '14'"), rollup).count() == rollup.count() - 1


def test_retention_run_twice(spark):
    log = to_landing_rows(landing_rows(spark), 0, F.lit("2026-07-05").cast("timestamp_ntz"))
    create_landing_table(log, "raw_events_test")
    first = run_retention(spark, "raw_events_test", "rollup_test", NOW)
    assert first == {"partitions_dropped": ["2026-03"], "rollup_rows_written": 2}
    assert spark.table("raw_events_test").count() == 2
    again = run_retention(spark, "raw_events_test", "rollup_test", NOW)
    assert again == {"partitions_dropped": [], "rollup_rows_written": 0}
    spark.sql("DROP TABLE raw_events_test")
    spark.sql("DROP TABLE rollup_test")
