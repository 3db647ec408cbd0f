from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tests.test_parse import line
from wirepulse.operators.metrics import over_limit
from wirepulse.plans import retention
from wirepulse.plans.retention import create_landing_table, expired_partitions, run_retention
from wirepulse.sources.landing import merge_log, read_log
from wirepulse.sources.folders import Folder
from wirepulse.sources.loads import LoadManifest
from wirepulse.streaming.ingest import batch_writer, start_ingest
from wirepulse.streaming.rates import read_counts, start_counts


def test_files_arrive_over_time(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    (folder / "20260704120000.csv").write_text(line() + "\n" + line(global_event_id="bad") + "\n")
    start_ingest(spark, str(folder), str(out), str(state)).awaitTermination()
    again = line(num_articles="77", actor1_name="OTHER")
    other = line(global_event_id="2", num_articles="1") + "\n" + line(global_event_id="2", num_articles="2")
    (folder / "20260704121500.csv").write_text(again + "\n" + other + "\n")
    start_ingest(spark, str(folder), str(out), str(state)).awaitTermination()
    log = read_log(spark, str(out))
    got = {r.global_event_id: (r.num_articles, r.actor1_name) for r in merge_log(log).collect()}
    assert got == {1234567890: (77, "FRANCE"), 2: (2, "FRANCE")}
    # The same state finds nothing new.
    start_ingest(spark, str(folder), str(out), str(state)).awaitTermination()
    assert read_log(spark, str(out)).count() == log.count() == 3


def test_replayed_batch_changes_nothing(spark, tmp_path):
    lines = spark.createDataFrame([("c", "f", 0, line())], "cycle string, file string, block bigint, value string")
    write = batch_writer(str(tmp_path / "out"))
    seen = set()
    for _ in range(2):
        write(lines, 0)
        seen.add(str(read_log(spark, str(tmp_path / "out")).collect()))
    assert len(seen) == 1  # load time included
    write(lines, 1)
    assert read_log(spark, str(tmp_path / "out")).count() == 2


def test_streams_that_take_turns_keep_all_loads(spark, tmp_path):
    """A, then B, then A and B again: nothing of one stream replaces what the other wrote."""
    out = str(tmp_path / "out")

    def run(stream, ids, minute):
        folder = tmp_path / stream
        folder.mkdir(exist_ok=True)
        (folder / f"202607041200{minute:02}.csv").write_text("\n".join(line(global_event_id=str(i), num_articles=str(minute)) for i in ids) + "\n")
        start_ingest(spark, str(folder), out, str(tmp_path / f"state-{stream}")).awaitTermination()
        return {r.global_event_id: (r.num_articles, r.load_seq) for r in merge_log(read_log(spark, out)).collect()}

    assert run("a", [1, 2], 1) == {1: (1, 0), 2: (1, 0)}
    assert run("b", [2, 3, 4], 2) == {1: (1, 0), 2: (2, 1), 3: (2, 1), 4: (2, 1)}
    assert run("a", [1, 5], 3) == {1: (3, 2), 2: (2, 1), 3: (2, 1), 4: (2, 1), 5: (3, 2)}
    assert run("b", [5], 4)[5] == (4, 3) and read_log(spark, out).count() == 8
    assert LoadManifest(spark, out).numbers() == [0, 1, 2, 3]


def test_load_numbers(spark, tmp_path):
    """Numbers are unique, stay with their batch, and one lost before it was named is left unused."""
    out = str(tmp_path / "log")
    manifest = LoadManifest(spark, out)
    first = manifest.reserve("a", 0)
    assert manifest.reserve("a", 0) == first and first.number == 0
    lost = Folder(spark, f"{out}/_loads/numbers")
    assert lost.create("1") and not lost.create("1")  # another stream died here
    assert [manifest.reserve(s, b).number for s, b in (("b", 0), ("a", 1), ("b", 0), ("a", 10))] == [2, 3, 2, 4]
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: LoadManifest(spark, out).reserve(f"s{i}", 0).number, range(16)))
    assert sorted(got) == list(range(5, 21))


def test_a_log_from_before_the_numbers(spark, tmp_path):
    out = str(tmp_path / "out")
    lines = spark.createDataFrame([("c", "f", 0, line())], "cycle string, file string, block bigint, value string")
    batch_writer(out)(lines, 0)
    (tmp_path / "out" / "load_seq=0").rename(tmp_path / "out" / "load_seq=41")
    old = str(tmp_path / "old")
    (tmp_path / "old").mkdir()
    (tmp_path / "out" / "load_seq=41").rename(tmp_path / "old" / "load_seq=41")
    batch_writer(old)(lines, 0)
    assert sorted(r.load_seq for r in read_log(spark, old).collect()) == [41, 42]


def test_a_fresh_checkpoint_adds_to_the_log(spark, tmp_path):
    """Neither a second stream nor a new checkpoint replaces earlier loads."""
    out = str(tmp_path / "out")
    for n in ("1", "2", "3"):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        (folder / f"2026070412{n}000.csv").write_text(line(global_event_id=n) + "\n")
        state = str(tmp_path / f"state{n}")
        for _ in range(2):  # the second start finds its own number again
            start_ingest(spark, str(folder), out, state).awaitTermination()
    log = read_log(spark, out)
    assert sorted((r.global_event_id, r.load_seq) for r in log.collect()) == [(1, 0), (2, 1), (3, 2)]
    again = tmp_path / "in3" / "20260704130000.csv"
    again.write_text(line(global_event_id="1", num_articles="9") + "\n")
    start_ingest(spark, str(tmp_path / "in3"), out, str(tmp_path / "state3")).awaitTermination()
    merged = {r.global_event_id: (r.num_articles, r.load_seq) for r in merge_log(read_log(spark, out)).collect()}
    assert merged[1] == (9, 3) and len(merged) == 3


def test_counts_are_complete(spark, tmp_path):
    """Late rows, the last window and a second stream count; a replay doesn't count twice."""
    source, out = tmp_path / "events", str(tmp_path / "out")

    def add(first, minutes):
        start = F.lit("2026-07-04 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(first))
        spark.range(minutes).select(
            (start + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts")
        ).write.mode("append").parquet(str(source))

    def run(state):
        stream = spark.readStream.schema("ts timestamp_ntz").parquet(str(source))
        start_counts(stream, "ts", "1 hour", out, str(tmp_path / state), "30 minutes").awaitTermination()
        return {str(r.window_start)[11:]: r.events for r in read_counts(spark, out).collect()}

    add(60, 60)
    assert run("state") == {"00:30:00": 30, "01:00:00": 60, "01:30:00": 30}
    add(0, 10)  # an hour late
    assert run("state") == {"23:30:00": 10, "00:00:00": 10, "00:30:00": 30, "01:00:00": 60, "01:30:00": 30}
    assert run("state")["01:00:00"] == 60 and run("other")["01:00:00"] == 120


def test_counts_per_user(spark, tmp_path):
    """Requests of a user that come in several batches are counted together, late ones too."""
    source, out, keys = str(tmp_path / "requests"), str(tmp_path / "out"), {"user_id": "bigint"}

    def run(*requests):
        rows = spark.createDataFrame(requests, "user_id bigint, ts string")
        rows.select("user_id", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("user_id bigint, ts timestamp_ntz").parquet(source)
        start_counts(stream, "ts", "1 minute", out, str(tmp_path / "state"), keys=keys).awaitTermination()
        return {(r.user_id, str(r.window_start)[11:], r.requests, r.rejected) for r in over_limit(read_counts(spark, out, keys), 2).collect()}

    assert run((1, "2026-07-04 12:00:01"), (1, "2026-07-04 12:00:59"), (2, "2026-07-04 12:00:30")) == set()
    assert run((1, "2026-07-04 12:00:02"), (2, "2026-07-04 12:01:00")) == {(1, "12:00:00", 3, 1)}
    late = [(None, "2026-07-04 11:00:00")] * 3
    assert run(*late) == {(1, "12:00:00", 3, 1), (None, "11:00:00", 3, 1)}


def test_partitions_go_with_few_statements(spark, monkeypatch):
    rows = spark.range(5).select(
        F.col("id").alias("global_event_id"), F.col("id").alias("load_seq"), F.lit("2026-01").alias("month"),
    )
    create_landing_table(rows, "many_loads")
    specs = expired_partitions(spark, "many_loads", "2026-07-05 00:00:00")
    assert [s["load_seq"] for s in specs] == ["0", "1", "2", "3", "4"]
    monkeypatch.setattr(retention, "SPECS_PER_STATEMENT", 2)
    retention.drop_partitions(spark, "many_loads", specs[:3])
    assert [r.load_seq for r in spark.table("many_loads").orderBy("load_seq").collect()] == [3, 4]
    retention.drop_partitions(spark, "many_loads", specs)
    assert spark.table("many_loads").count() == 0
    spark.sql("DROP TABLE many_loads")


def test_retention_on_the_ingested_layout(spark, tmp_path):
    """Expired months of a log that streams wrote are rolled up and their files go."""
    folder = tmp_path / "in"
    folder.mkdir()
    place = str(tmp_path / "landing")
    for day in ("20260301", "20260704"):
        (folder / f"{day}120000.csv").write_text(line(global_event_id=day, date_added=f"{day}120000") + "\n")
        start_ingest(spark, str(folder), place, str(tmp_path / "state")).awaitTermination()
    create_landing_table(read_log(spark, place), "landed_test")
    got = run_retention(spark, "landed_test", "landed_rollup_test", "2026-07-05 00:00:00")
    assert got == {"partitions_dropped": ["2026-03"], "rollup_rows_written": 1}
    assert [r.global_event_id for r in spark.table("landed_test").collect()] == [20260704]
    assert spark.table("landed_rollup_test").count() == 1
    spark.sql("DROP TABLE landed_test")
    spark.sql("DROP TABLE landed_rollup_test")


def test_month_filters_reach_the_merged_log(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "20260704120000.csv").write_text(line() + "\n")
    start_ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    merged = merge_log(read_log(spark, str(tmp_path / "out"))).filter("month = '2026-07'")
    plan = merged._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PartitionFilters: [isnotnull(month" in plan.replace("cast(", "").replace(" as string)", "")
    assert merged.count() == 1
