"""The cleaned and scored layer, brought up to date load by load instead of being rebuilt.

Stored is the latest row of each event id with the part of its score that time doesn't change, and
whether the row keeps the rules. A row that breaks them stays in the store: it hides older rows of its
id. The part of the score that fades is added when the layer is read, for any reference time.

A month lies in ``month=<m>/through=<n>``: its rows after all loads of the log up to ``n``. It counts
when ``_done/<n>`` is there, so a run that died changes nothing and the next one writes the same
folders again. One job at a time may refresh a layer; readers may come at any time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepulse.functions.scoring import as_of_column, attention, freshness
from wirepulse.operators.clean import clustered, newest_rows, usable
from wirepulse.params import ScoreParams
from wirepulse.schemas import EVENT_COLUMNS, EVENT_SCHEMA
from wirepulse.sources.folders import Folder
from wirepulse.sources.landing import read_current, read_log
from wirepulse.sources.loads import LoadManifest

_KEPT = [*EVENT_COLUMNS, "ingested_at", "load_seq", "attention", "usable", "month"]
_SCHEMA = EVENT_SCHEMA + (
    ", ingested_at timestamp_ntz, load_seq bigint, attention double, usable boolean, month string"
)


class ScoredLayer:
    def __init__(self, spark: SparkSession, path: str, params: ScoreParams = ScoreParams()):
        self.spark, self.path, self.params = spark, path, params
        self._folder = Folder(spark, path)

    def through(self) -> int:
        """The last load of the log that the layer holds, or -1."""
        return max((int(n) for n in self._folder.names("_done/*")), default=-1)

    def months(self) -> dict[str, int]:
        """Month -> the load through which its newest folder goes, from the names of folders."""
        done = {int(n) for n in self._folder.names("_done/*")}
        found: dict[str, int] = {}
        for month, through in self._folder.nested("month=*/through=*"):
            month, number = month.split("=")[1], int(through.split("=")[1])
            if number in done:
                found[month] = max(number, found.get(month, -1))
        return found

    def refresh(self, log_path: str) -> list[str]:
        """Take in the finished loads of a landing log behind the last ones; returns the months written.

        Only the months of the new loads and those in which their ids had a row are read and written; to
        find the latter, the ids alone of the other months are scanned. An id whose latest row moved to
        another month leaves the old one.
        """
        before, last = self.through(), LoadManifest(self.spark, log_path).finished_through()
        if last <= before:
            return []
        loads = read_log(self.spark, log_path).filter((F.col("load_seq") > before) & (F.col("load_seq") <= last))
        ids = loads.select("global_event_id").distinct()
        own = _months(loads)
        held = self._rows()
        touched = sorted({*own, *_months(held.join(ids, "global_event_id", "left_semi"))})
        if touched:
            self._write(log_path, own, touched, ids, last)
        self._folder.create(f"_done/{last}")
        self._forget(touched, before)
        return touched

    def _write(self, log_path: str, own: list[str], touched: list[str], ids: DataFrame, last: int) -> None:
        # The log gives a key as all loads left it, whichever of them are new.
        current = read_current(self.spark, log_path, own, last).join(ids, "global_event_id", "left_semi")
        scored = current.withColumns({"attention": attention(self.params), "usable": usable()}).select(*_KEPT)
        old = self._rows(touched)
        again = newest_rows(scored.unionByName(old.join(ids, "global_event_id", "left_semi").select(*_KEPT)))
        others = old.join(ids, "global_event_id", "left_anti").select(*_KEPT)
        rows = clustered(others.unionByName(again)).withColumn("through", F.lit(last))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "through").parquet(self.path)
        written = set(self._folder.nested("month=*/through=*"))
        for month in touched:
            if (f"month={month}", f"through={last}") not in written:  # all its ids moved away
                self._folder.create(f"month={month}/through={last}/_empty")

    def _forget(self, touched: list[str], before: int) -> None:
        """Deletes the folders of months written now that no reader can have begun with since the last refresh."""
        for month in touched:
            numbers = sorted(int(n.split("=")[1]) for n in self._folder.names(f"month={month}/through=*"))
            for number in [n for n in numbers if n <= before][:-1]:
                self._folder.delete(f"month={month}/through={number}")

    def _rows(self, months: list[str] | None = None) -> DataFrame:
        """The stored rows of all months or of some; folders are chosen by name."""
        chosen = {m: n for m, n in self.months().items() if months is None or m in months}
        if not chosen:
            return self.spark.createDataFrame([], _SCHEMA)
        paths = [f"{self.path}/month={m}/through={n}" for m, n in sorted(chosen.items())]
        rows = self.spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(*paths)
        return rows.withColumn("month", F.col("month").cast("string")).select(*_KEPT)

    def read(self, as_of: datetime | str | Column, months: list[str] | None = None) -> DataFrame:
        """The scored events relative to ``as_of``, of all months or some: what ``score(clean(...))`` of the
        current rows of the log gives, with the month."""
        value = F.col("attention") + freshness(as_of, self.params)
        return self._rows(months).filter("usable").select(
            *EVENT_COLUMNS, "ingested_at", "load_seq", value.alias("intensity"),
            as_of_column(as_of).alias("scored_at"), "month",
        )


def _months(rows: DataFrame) -> list[str]:
    """The months of some rows, a list as long as the calendar."""
    return [r.month for r in rows.select("month").distinct().collect()]
