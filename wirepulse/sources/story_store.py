"""Stored story runs: one folder per run, named by its time.

A run is added without touching others. The newest run is known from the folder names, and a reader of
some runs lists and opens those only. Runs past their retention go as whole folders.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepulse.params import StoryParams
from wirepulse.sources.folders import Folder

STORY_SCHEMA = (
    "story_id bigint, rep_title string, rep_url string, lat double, lon double, member_count bigint, "
    "total_articles bigint, total_sources bigint, intensity double, avg_tone double, trend string, "
    "articles_last_hour bigint, articles_prev_hour bigint, source_urls array<string>, location string, "
    "country_code string, earliest timestamp_ntz, latest timestamp_ntz, label string, summary string, "
    "run_at timestamp_ntz"
)
MEMBER_SCHEMA = "story_id bigint, global_event_id bigint"
_KEY = "run_key"


def run_key(run_at: datetime) -> str:
    return run_at.strftime("%Y%m%d%H%M%S")


class StoryStore:
    """Stories below ``<path>/stories`` and the ids of their members below ``<path>/members``."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")

    def append(
        self, run_at: datetime, stories: DataFrame, members: DataFrame, params: StoryParams = StoryParams()
    ) -> list[str]:
        """Add a run, then drop runs past their retention at its time; returns the dropped runs' keys.

        A run that is stored again replaces itself. The stories come last, so that a run counts only
        when its members are there.
        """
        key = F.lit(run_key(run_at))
        for rows, schema, name in ((members, MEMBER_SCHEMA, "members"), (stories, STORY_SCHEMA, "stories")):
            columns = [F.col(f.name).cast(f.dataType) for f in self._spark.createDataFrame([], schema).schema]
            rows.select(*columns, key.alias(_KEY)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy(_KEY).parquet(f"{self._path}/{name}")
        return self.drop_before(run_at - timedelta(hours=params.retention_hours))

    def keys(self) -> list[str]:
        """The stored runs, oldest first, from the names of their folders."""
        return sorted(n.split("=")[1] for n in Folder(self._spark, f"{self._path}/stories").names(f"{_KEY}=*"))

    def stories(self, chosen: Callable[[list[str]], list[str]] = lambda keys: keys) -> DataFrame:
        return self._read("stories", STORY_SCHEMA, chosen(self.keys()))

    def latest(self, until: datetime | None = None) -> DataFrame:
        """Stories of the newest run, or the newest up to a moment; none if there is no run."""
        return self.stories(lambda keys: self._newest(keys, until))

    def latest_members(self, until: datetime | None = None) -> DataFrame:
        return self._read("members", MEMBER_SCHEMA, self._newest(self.keys(), until))

    def drop_before(self, oldest: datetime) -> list[str]:
        expired = [k for k in self.keys() if k < run_key(oldest)]
        for key in expired:
            for name in ("stories", "members"):
                Folder(self._spark, f"{self._path}/{name}").delete(f"{_KEY}={key}")
        return expired

    @staticmethod
    def _newest(keys: list[str], until: datetime | None) -> list[str]:
        return [k for k in keys if until is None or k <= run_key(until)][-1:]

    def _read(self, name: str, schema: str, keys: list[str]) -> DataFrame:
        if not keys:
            return self._spark.createDataFrame([], schema)
        rows = self._spark.read.schema(f"{schema}, {_KEY} string").parquet(f"{self._path}/{name}")
        return rows.filter(F.col(_KEY).isin(keys)).drop(_KEY)
