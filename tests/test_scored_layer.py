"""The scored layer kept up load by load equals the full rebuild."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_validate_clean import batch, event
from wirepulse.operators.clean import clean, score
from wirepulse.plans.scored_layer import ScoredLayer
from wirepulse.sources.landing import append_batch, compact_log, merge_log, read_log, to_landing_rows
from wirepulse.sources.loads import LoadManifest

MAY, JUNE, JULY = (dt.datetime(2026, m, 3, 12) for m in (5, 6, 7))
AS_OF = dt.datetime(2026, 7, 4)
COLUMNS = ["global_event_id", "month", "date_added", "num_articles", "intensity", "scored_at"]


class Log:
    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.loads = spark, str(tmp_path / "log"), 0
        self.manifest = LoadManifest(spark, self.path)

    def add(self, *rows, finish=True):
        load = self.manifest.reserve("s", self.loads)
        self.loads += 1
        taken = F.lit(JULY + dt.timedelta(hours=load.number)).cast("timestamp_ntz")
        append_batch(to_landing_rows(batch(self.spark, list(rows)), load.number, taken), self.path)
        if finish:
            self.manifest.finish(load)
        return load

    def rebuilt(self):
        rows = score(clean(merge_log(read_log(self.spark, self.path))), AS_OF)
        rows = rows.withColumn("month", F.date_format("date_added", "yyyy-MM"))
        return sorted(map(tuple, rows.select(*COLUMNS).collect()))


def rows_of(layer, months=None):
    return sorted(map(tuple, layer.read(AS_OF, months).select(*COLUMNS).collect()))


def test_a_load_rewrites_only_its_months(spark, tmp_path):
    log, layer = Log(spark, tmp_path), ScoredLayer(spark, str(tmp_path / "layer"))
    assert layer.read(AS_OF).count() == 0
    log.add(event(1, date_added=MAY), event(2, date_added=JUNE), event(3, date_added=JULY), event(4, date_added=MAY))
    assert layer.refresh(log.path) == ["2026-05", "2026-06", "2026-07"] and layer.refresh(log.path) == []
    assert rows_of(layer) == log.rebuilt()
    log.add(event(3, date_added=JULY, num_articles=90), event(5, date_added=JULY))
    assert layer.refresh(log.path) == ["2026-07"]
    assert layer.months() == {"2026-05": 0, "2026-06": 0, "2026-07": 1}
    assert rows_of(layer) == log.rebuilt()
    assert {r[0] for r in rows_of(layer, ["2026-07"])} == {3, 5} and rows_of(layer, ["2025-01"]) == []


def test_ids_that_move_leave_their_month_and_bad_rows_hide_older_ones(spark, tmp_path):
    log, layer = Log(spark, tmp_path), ScoredLayer(spark, str(tmp_path / "layer"))
    log.add(event(1, date_added=MAY), event(2, date_added=JUNE), event(3, date_added=JUNE))
    layer.refresh(log.path)
    # The only id of May moves to July, one of June breaks a rule, an older row of an id comes late.
    log.add(event(1, date_added=JULY), event(2, date_added=JUNE, num_articles=-4), event(3, date_added=MAY))
    assert layer.refresh(log.path) == ["2026-05", "2026-06", "2026-07"]
    assert rows_of(layer) == log.rebuilt() and [r[:2] for r in rows_of(layer)] == [(1, "2026-07"), (3, "2026-06")]
    log.add(event(2, date_added=MAY))  # older than the bad row
    layer.refresh(log.path)
    assert rows_of(layer) == log.rebuilt() and len(rows_of(layer)) == 2
    log.add(event(2, date_added=JUNE, num_articles=4))  # good again
    compact_log(spark, log.path)
    assert layer.refresh(log.path) == ["2026-06"] and rows_of(layer) == log.rebuilt() and len(rows_of(layer)) == 3
    folders = sorted(p.name for p in (tmp_path / "layer/month=2026-06").iterdir())
    assert folders == ["through=2", "through=3"]  # the one before stays for readers that have begun


def test_unfinished_loads_and_runs_that_died(spark, tmp_path):
    log, layer = Log(spark, tmp_path), ScoredLayer(spark, str(tmp_path / "layer"))
    log.add(event(1, date_added=JUNE))
    layer.refresh(log.path)
    before = rows_of(layer)
    late = log.add(event(1, date_added=JUNE, num_articles=50), finish=False)
    log.add(event(2, date_added=JULY))
    assert layer.refresh(log.path) == [] and rows_of(layer) == before
    log.manifest.finish(late)
    layer.refresh(log.path)
    assert rows_of(layer) == log.rebuilt()
    (tmp_path / "layer/_done/2").unlink()  # died before its end: the run before counts
    assert rows_of(layer) == before
    assert layer.refresh(log.path) == ["2026-06", "2026-07"] and rows_of(layer) == log.rebuilt()


def test_months_are_chosen_by_folder(spark, tmp_path):
    log, layer = Log(spark, tmp_path), ScoredLayer(spark, str(tmp_path / "layer"))
    log.add(event(1, date_added=MAY), event(2, date_added=JULY))
    layer.refresh(log.path)
    files = layer.read(AS_OF, ["2026-07"]).inputFiles()
    assert files and all("month=2026-07" in f for f in files)
