from wirepulse.sources.landing import merge_log, read_log
from wirepulse.streaming.titled import dropped_rows, start_titled_ingest

from tests.test_parse import line


def title_line(url, title):
    fields = [""] * 27
    fields[4], fields[26] = url, f"<PAGE_TITLE>{title}</PAGE_TITLE>"
    return "\t".join(fields)


class Feed:
    """Two folders that files arrive in, and runs over what is there."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        for name in ("events", "titles"):
            (folder / name).mkdir()

    def put(self, name, cycle, *lines):
        (self.folder / name / f"{cycle}.csv").write_text("".join(x + "\n" for x in lines))

    def run(self, delay="15 minutes"):
        paths = [str(self.folder / n) for n in ("events", "titles", "out", "state")]
        self.query = start_titled_ingest(self.spark, *paths, delay=delay)
        self.query.awaitTermination()

    def rows(self):
        try:
            log = read_log(self.spark, str(self.folder / "out"))
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return {}
            raise
        return {(r.cycle.split("/")[-1][:14], r.global_event_id): (r.page_title, r.num_articles) for r in log.collect()}


def event(number, url="https://a", **fields):
    return line(global_event_id=str(number), source_url=url, **fields)


def test_events_wait_for_the_titles_of_their_cycle(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put("events", "20260704120000", event(1), event(2, "https://b"), event(3, ""), event(1, num_articles="77"))
    feed.run()
    assert feed.rows() == {}  # the cycle is open, its titles may still come
    feed.put("titles", "20260704120000", title_line("https://a", "old"), title_line("https://a", "noon"))
    feed.put("titles", "20260704121500", title_line("https://a", "quarter past"), title_line("https://b", "other"))
    feed.put("events", "20260704121500", event(1), event(4))
    feed.run()
    feed.put("events", "20260704123000", event(9))
    feed.put("titles", "20260704123000", title_line("https://a", "half past"))
    feed.run()
    noon = {("20260704120000", 1): ("noon", 77), ("20260704120000", 2): (None, 33), ("20260704120000", 3): (None, 33)}
    got = feed.rows()
    assert {k: v[0] for k, v in got.items() if k[0] == "20260704120000"} == {k: v[0] for k, v in noon.items()}
    assert got[("20260704120000", 1)][1] == 77  # the last line of the cycle
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "20260704121500"} == {1: "quarter past", 4: "quarter past"}
    assert not any(k[0] == "20260704123000" for k in got)  # waits for the next cycle
    log = read_log(spark, str(tmp_path / "out"))
    assert log.count() == len(got)  # each row once
    assert {r.page_title for r in merge_log(log).filter("global_event_id = 1").collect()} == {"quarter past"}
    assert dropped_rows(feed.query) == 0


def test_late_lines_are_counted_and_a_delay_keeps_them(spark, tmp_path):
    for delay, lost in (("0 seconds", True), ("1 hour", False)):
        (tmp_path / delay).mkdir()
        feed = Feed(spark, tmp_path / delay)
        for cycle in ("20260704120000", "20260704123000"):
            feed.put("events", cycle, event(1))
            feed.put("titles", cycle, title_line("https://a", cycle))
        feed.run(delay)
        feed.put("events", "20260704121500", event(7))
        feed.run(delay)
        assert (dropped_rows(feed.query) > 0) == lost
        for name, text in (("events", event(8)), ("titles", title_line("https://a", "x"))):
            feed.put(name, "20260705120000", text)
        feed.run(delay)
        assert (("20260704121500", 7) in feed.rows()) != lost


def test_open_cycles_are_held_on_disk_whatever_a_batch_finds(spark, tmp_path):
    """The store in the executors' memory would grow with the lines of a batch; other streams keep theirs."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    feed = Feed(spark, tmp_path)
    for cycle in ("20260704120000", "20260704121500"):
        feed.put("events", cycle, *(event(i, f"https://{i % 7}") for i in range(40)))
        feed.put("titles", cycle, *(title_line(f"https://{i}", f"{cycle} {i}") for i in range(5)))
    feed.run("0 seconds")
    want = {(c, i): f"{c} {i % 7}" if i % 7 < 5 else None for c in ("20260704120000", "20260704121500") for i in range(40)}
    assert {k: v[0] for k, v in feed.rows().items()} == want
    stores = [s for p in feed.query.recentProgress for s in p["stateOperators"]]
    assert stores and all(any(name.startswith("rocksdb") for name in s["customMetrics"]) for s in stores)
    assert spark.conf.get(provider) == before
